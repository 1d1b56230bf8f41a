"""Text measures on columns: markup to text, sentences, lexicon counts, syllables, stems."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists of the tone measures; a word listed twice counts twice.
LEXICONS = {
    "hedges": ["may", "might", "could", "perhaps", "possibly", "we think", "we believe", "appears", "seems", "somewhat", "fairly", "rather", "generally", "typically", "usually", "often", "helps", "aims to", "designed to", "up to", "best effort"],
    "power": ["fastest", "best", "leading", "unmatched", "powerful", "instantly", "effortless", "revolutionary", "breakthrough", "delightful", "love", "faster", "simplest", "seamless", "robust", "powerful", "scale", "unlock", "transform", "ultimate", "definitive", "remarkable", "delightful", "magic", "supercharge", "10x"],
    "warmth": ["you", "your", "you're", "you'll", "we", "our", "together", "hello", "welcome", "thank", "care", "community", "human", "friendly", "love", "join", "share", "everyone", "real people", "story"],
    "formality": ["therefore", "furthermore", "accordingly", "hereby", "aforementioned", "utilise", "endeavour", "regarding", "notwithstanding", "commence", "terminate"],
    "casual": ["lol", "yeah", "hey", "gonna", "wanna", "kinda", "sorta", "awesome", "super", "totally", "literally", "basically", "pretty much", "stuff", "things", "guys", "awesome", "amazing", "insane", "mind-blowing", "stuff"],
    "jargon": ["kubernetes", "microservices", "serverless", "api", "sdk", "cli", "saas", "idp", "sso", "kubernetes-native", "infrastructure", "pipeline", "workflow", "deployment", "observability", "orchestration", "runtime", "data lake"],
}
#: Sentences holding one of these are no copy.
BOILERPLATE = ["cookie", "privacy policy", "terms of service", "all rights reserved", "subscribe to our newsletter", "follow us on", "©", "inc.", "llc", "accept all", "manage preferences", "sign up", "get started for free"]


def html_to_text(html: Column) -> Column:
    """Text of a page without scripts, styles and page furniture; blanks collapsed."""
    t = html
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        t = F.regexp_replace(t, f"(?is)<{tag}.*?</{tag}>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for ref, to in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&apos;", "'"), ("&quot;", '"'), ("&#8217;|&rsquo;", "'"), ("&#8211;|&ndash;", "-"), ("&#8212;|&mdash;", "—"), ("&#[0-9]+;", " ")):
        t = F.regexp_replace(t, f"(?i){ref}", to)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Distinct sentences of 28 to 320 characters that hold a space, a letter, at most two stops and no boilerplate."""
    split = F.split(F.regexp_replace(text, r"([.!?…])\s+", "$1\n"), "\n")
    trimmed = F.transform(split, lambda s: F.trim(s))
    return F.array_distinct(F.filter(trimmed, lambda s: F.length(s).between(28, 320) & s.rlike("[A-Za-z]") & F.contains(s, F.lit(" ")) & (F.length(s) - F.length(F.translate(s, ".!?", "")) <= 2) & s.rlike("^[A-Z0-9\"']") & ~F.lower(s).rlike(_any(BOILERPLATE))))


def _any(terms: list[str]) -> str:
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")"


def _apart(terms: list[str]) -> list[list[str]]:
    """Groups of terms of which no two can match at overlapping places, so that one pass counts a whole group."""

    def clash(x: str, y: str) -> bool:
        edge = r"(?<![a-z0-9_])%s(?![a-z0-9_])"
        return bool(x == y or re.search(edge % re.escape(x), y) or re.search(edge % re.escape(y), x))

    groups: list[list[str]] = []
    for t in terms:
        for g in groups:
            if not any(clash(t, x) for x in g):
                g.append(t)
                break
        else:
            groups.append([t])
    return groups


def _among(words: Column, terms: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(terms)))


def _plain(terms: list[str]) -> list[str]:
    return [t for t in terms if re.fullmatch("[a-z0-9_]+", t)]


def _branches(terms: list[str]) -> str:
    """A pattern of plain terms that tries a common beginning once."""
    tree: dict = {}
    for t in terms:
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        rest = [c + pattern(x) for c, x in at.items() if c]
        return ("(?:" + "|".join(rest) + ")" if rest else "") + ("?" if rest and "" in at else "")

    return pattern(tree)


def listed(low: Column, *lists: list[str]) -> Column:
    """The words of lower-cased text, runs of a-z, 0-9 and _, that are terms of any of the lists: few, so that no list's count reads all words."""
    terms = _branches([t for terms in lists for t in _plain(terms)])
    return F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9_])({terms})(?![a-z0-9_])"), 1)


def word_count(text: Column) -> Column:
    """Runs without blanks, tabs, line feeds and carriage returns."""
    for gap in "\t\n\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), ""))


def times(text: Column, part: str) -> Column:
    """Occurrences of a part, counted from the left without overlaps."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def term_count(text: Column, terms: list[str], words: Column | None = None) -> Column:
    """Occurrences of all terms in lower-cased text: words on ASCII boundaries, phrases as substrings.

    words: those ``listed``, where several counts share them; the text is then lower-cased already. Terms with
    other characters are counted by regular expressions in texts that hold one, phrases by replacing.
    """
    low = F.lower(text) if words is None else text
    words = listed(low, terms) if words is None else words
    total: Column = F.lit(0)
    plain = _plain(terms)
    while plain:  # a term listed twice counts twice
        once = list(dict.fromkeys(plain))
        total = total + _among(words, once)
        for t in once:
            plain.remove(t)
    for g in _apart([t for t in terms if " " not in t and t not in _plain(terms)]):
        held = reduce(operator.or_, [F.contains(low, F.lit(t)) for t in g])
        total = total + F.when(held, F.regexp_count(low, F.lit(f"(?<![A-Za-z0-9_]){_any(g)}(?![A-Za-z0-9_])"))).otherwise(F.when(low.isNotNull(), 0))
    for t in terms:
        if " " in t:
            total = total + times(low, t)
    return total


def syllables(text: Column) -> Column:
    """Estimated syllables of all words, without their apostrophes: one for up to three letters, else vowel groups after dropping silent endings."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)
    def one(w: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
        return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]{1,2}"))))
    return F.aggregate(F.transform(F.transform(words, lambda w: F.replace(w, F.lit("'"), F.lit(""))), one), F.lit(0), lambda a, x: a + x)


def stem(word: Column) -> Column:
    """Singular form by ending."""
    return F.when((F.length(word) <= 3) | word.rlike("(ss|us|is|ous|ics)$"), word).when((F.length(word) > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
