"""Text as column expressions: cleaning, keys, blanks, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it, for java.util.regex (its \s is ASCII only).
SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Contraction spellings that lost their apostrophe, and the repaired form.
CONTRACTIONS = {
    "dont": "don't", "didnt": "didn't", "doesnt": "doesn't", "wont": "won't", "cant": "can't", "isnt": "isn't",
    "wasnt": "wasn't", "arent": "aren't", "werent": "weren't", "couldnt": "couldn't", "wouldnt": "wouldn't",
    "shouldnt": "shouldn't", "hasnt": "hasn't", "havent": "haven't", "hadnt": "hadn't", "youre": "you're",
    "theyre": "they're", "weve": "we've", "ive": "I've", "im": "I'm", "thats": "that's", "whats": "what's",
}


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white space only."""
    return c.isNull() | ~c.rlike("[^" + SPACE[1:])


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def norm_key(c: Column) -> Column:
    """Everything but letters and digits becomes a space, runs of them one, in lower case. NULL gives ''."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]+", " ")))


def letters_digits(c: Column) -> Column:
    """Only letters and digits, in lower case. NULL gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]+", ""))


def digest(c: Column) -> Column:
    """16 bytes that stand for a text when grouping or joining; equality is confirmed on the text where it matters."""
    return F.unhex(F.md5(c.cast("binary")))


def clean_text(c: Column) -> Column:
    """Curly quotes and dashes to ASCII, white space squeezed, lost apostrophes of known contractions restored (closing
    punctuation is kept, opening punctuation of a repaired token is not). NULL gives ''."""
    table = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])
    plain = F.translate(F.coalesce(c, F.lit("")), "‘’“”–—", "''\"\"--")

    def repaired(tok: Column) -> Column:
        bare = F.regexp_replace(F.lower(tok), "^[.,!?;:\"'()]+|[.,!?;:\"'()]+$", "")
        return F.when(F.try_element_at(table, bare).isNotNull(), F.concat(F.try_element_at(table, bare), F.regexp_extract(tok, "[.,!?;:\"')]*$", 0))).otherwise(tok)

    return F.array_join(F.transform(F.split(squeeze(plain), " "), repaired), " ")


def digit_tokens(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0)))


def word_count(c: Column) -> Column:
    words = squeeze(F.coalesce(c, F.lit("")))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, " ")))


def subject_list(c: Column) -> Column:
    """The '$'-separated values of a well-formed subjects string, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[$]"), lambda x: F.trim(x)), lambda x: x != "")


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("[unknown]"))


def parse_score(c: Column) -> Column:
    """The first number of a response, held within 0 and 100; NULL without one."""
    number = F.nullif(F.regexp_extract(c, "[0-9]+(?:\\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))


def first_token_probability(tokens: Column) -> Column:
    """P(True) from a map of first tokens to log probabilities: the greatest of each side, their ratio when both are
    there, one side alone otherwise, NULL with neither."""
    side = lambda word: F.array_max(F.transform(F.filter(F.map_entries(tokens), lambda e: F.lower(F.trim(e.key)).startswith(word)), lambda e: F.exp(e.value)))
    t, f = side("true"), side("false")
    p = F.when(t.isNotNull() & f.isNotNull(), t / (t + f)).when(f.isNotNull(), 1 - f).otherwise(t)
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def token_logsumexp(tokens: Column, word: str) -> Column:
    """The log of the summed probabilities of the first tokens that are ``word`` once quotes, dots and underscores around
    them are left out, from a map of tokens to log probabilities; NULL where there is none."""
    bare = lambda t: F.lower(F.regexp_replace(F.trim(t), "^[\"'._]+|[\"'._]+$", ""))
    mine = F.transform(F.filter(F.map_entries(tokens), lambda e: bare(e.key) == word), lambda e: e.value)
    top = F.array_max(mine)
    return F.when(F.size(mine) > 0, top + F.ln(F.aggregate(mine, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def as_int(c: Column, default: int = 0) -> Column:
    """A number as text or double, rounded half to even; ``default`` for what is no number."""
    return F.coalesce(F.bround(F.expr("1D") * c.try_cast("double")).try_cast("long"), F.lit(default))
