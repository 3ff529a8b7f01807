"""Text scalar functions and predicates as column expressions.

The word class is ``[\\p{L}\\p{N}_]`` throughout.  Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the normalisers.
URL = r"http\S+|www\S+"
URL_STRICT = r"https?://\S+|www\.\S+"
MENTION = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#([\p{L}\p{N}_]+)"
NON_WORD = r"[^\p{L}\p{N}_\s]"
NON_WORD_CJK = r"[^\p{L}\p{N}_\s一-鿿]"
ENTITY = r"&[\p{L}\p{N}_]+;"
TOKEN = r"(\p{L}[\p{L}\p{N}_'-]*)"

# Stop words of the short-text tokeniser.
STOP_WORDS = """
a an the of for and or to in on with by from at as is are be been we our us this that it its i you your he she they
them his her their what which who when where how all any both each few more most other some such no nor not only own
same so than too very can will just don should now do does did doing have has had having if because until while about
against between into through during before after above below up down out off over under again further then once here
there why
""".split()

# Code-point ranges of the scripts told apart, by script id.
SCRIPT_RANGES = {
    1: r"\x{0400}-\x{052F}",
    2: r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}",
    3: r"\x{0600}-\x{06FF}",
    4: r"\x{0590}-\x{05FF}",
    5: r"\x{0E00}-\x{0E7F}",
    6: r"\x{0900}-\x{097F}",
}


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, gap: str = "") -> Column:
    """Lower case; links and handles replaced by ``gap``; hashtags without their sign; other signs as spaces."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), URL, gap), MENTION, gap)
    return squeeze(F.regexp_replace(F.regexp_replace(c, HASHTAG, "$1"), NON_WORD, " "))


def clean_long(c: Column) -> Column:
    return clean(c, " ")


def clean_short_safe(c: Column) -> Column:
    """The steps of ``clean_short`` that need neither look-around nor back-references."""
    c = F.regexp_replace(F.regexp_replace(c, URL_STRICT, " "), r"(?i)^rt\s+", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(c, MENTION, " "), HASHTAG, "$1"))


def clean_short(c: Column, most: int = 4000) -> Column:
    """Case kept; camel case split, runs of one character squeezed to two, cut to ``most`` characters."""
    c = F.regexp_replace(F.regexp_replace(c, URL_STRICT, " "), r"(?i)^rt\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, MENTION, " "), HASHTAG, "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"(.)\1{2,}", "$1$1")
    return F.substring(squeeze(c), 1, most)


def clean_projection(c: Column, most: int = 1000) -> Column:
    c = F.lower(F.regexp_replace(F.regexp_replace(c, URL_STRICT, " "), MENTION, " "))
    return F.substring(squeeze(F.regexp_replace(F.regexp_replace(c, ENTITY, " "), NON_WORD_CJK, " ")), 1, most)


def is_empty_after_clean(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(c), URL_STRICT, " "), MENTION, " ")
    return F.length(squeeze(F.regexp_replace(F.regexp_replace(c, HASHTAG, "$1"), NON_WORD, " "))) == 0


def tokens(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), 1), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def script_id(c: Column) -> Column:
    """The script with most characters if it has at least an eighth of them, else 0; the lowest id on a tie."""
    counts = [F.length(F.regexp_replace(c, f"[^{r}]", "")) for r in SCRIPT_RANGES.values()]
    top = F.greatest(*counts)
    pick = F.lit(0)
    for sid, n in reversed(list(zip(SCRIPT_RANGES, counts, strict=True))):
        pick = F.when(n == top, sid).otherwise(pick)
    return F.when((top > 0) & (top * 8 >= F.greatest(F.length(c), F.lit(1))), pick).otherwise(0)


def has_newline(c: Column) -> Column:
    return F.contains(c, F.lit("\n"))


def has_url(c: Column) -> Column:
    return F.lower(c).rlike(r"http|www\.")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]")


def has_punctuation(c: Column) -> Column:
    return c.rlike(r"[\p{P}$+<=>^`|~]")


def pre_tokens(c: Column) -> Column:
    """White-space split with every punctuation character a token of its own."""
    return F.filter(F.split(F.regexp_replace(c, r"([\p{P}$+<=>^`|~])", " $1 "), r"\s+"), lambda t: t != "")


def flatten_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\n\s*", " ")


def archive_of(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def last_path_part(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def placeholder(c: Column, text: str = "x") -> Column:
    return F.when(F.length(c) == 0, text).otherwise(c)


def statements(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[;\n]"), F.trim), lambda s: s != "")


def symmetric_difference_size(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def number_ranges(c: Column) -> Column:
    """``0,3-5`` as an array of integers."""
    def one(p: Column) -> Column:
        lo = F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
        hi = F.split_part(p, F.lit("-"), F.lit(-1)).cast("int")
        return F.sequence(lo, hi)

    return F.flatten(F.transform(F.split(c, ","), one))


def encode_ids(ids: Column, most: int, first: int, last: int) -> Column:
    """Ids framed by a first and a last one, cut so that ``most`` remain."""
    return F.concat(F.array(F.lit(first)), F.slice(ids, 1, most - 2), F.array(F.lit(last)))


def word_ngrams(tok: Column) -> Column:
    """Unigrams and bigrams of an array of tokens."""
    two = F.when(
        F.size(tok) > 1,
        F.transform(F.sequence(F.lit(1), F.size(tok) - 1), lambda i: F.concat(F.element_at(tok, i), F.lit(" "), F.element_at(tok, i + 1))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tok, two)


def char_wb(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside words padded by one space on each side; a padded word of at most ``n`` characters
    gives itself once and no larger size."""
    padded = F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def grams(w: Column) -> Column:
        n_max = F.least(F.lit(hi), F.greatest(F.lit(lo), F.length(w)))
        def size(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(lo), n_max), size))
    return F.flatten(F.transform(padded, grams))


def stable_uniform(key: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    return stable_hash(F.concat(F.lit(f"{seed}:"), key.cast("string"))) / F.lit(float(1 << 32))


def stable_hash(c: Column) -> Column:
    """A 32-bit number from the MD5 digest, the same in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
