"""Text functions: tokenisers, stop-word removal, n-grams, previews.

All of them are Column -> Column expressions built from Spark's own
functions, so they run inside whole-stage codegen on the JVM; nothing
here calls Python per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once
from .fixed import PY_WHITESPACE

WS = f"[{PY_WHITESPACE}]"
NOT_WS = f"[^{PY_WHITESPACE}]"

# Runs of word characters (letters, numbers, underscore) - the maximal runs
# a Unicode ``\b...\b`` pattern can match whole.
WORD_RUN = r"[\p{L}\p{N}_]+"
# Runs of word characters that are not decimal digits (gensim's alphabetic
# token: letters, letter-numbers, other numbers, underscore).
ALPHA_RUN = r"[\p{L}\p{Nl}\p{No}_]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode white space."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def ws_tokens(col) -> Column:
    """Python ``str.split()``: the white-space separated pieces."""
    return F.regexp_extract_all(_c(col), F.lit(f"{NOT_WS}+"), F.lit(0))


# every character Python's str.split() treats as white space
_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
             "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def word_count(col) -> Column:
    """``len(text.split())``: white space mapped to ' ' by ``translate`` (a
    char table), then runs of non-space counted - no token strings built."""
    t = F.translate(_c(col), _WS_CHARS, " " * len(_WS_CHARS))
    return F.regexp_count(t, F.lit("[^ ]+")).cast("long")


def has_words(col, n: int) -> Column:
    """At least n white-space separated words; stops scanning after n."""
    if n <= 0:
        return F.lit(True)
    return _c(col).rlike(f"^{WS}*(?:{NOT_WS}+{WS}+){{{n - 1}}}{NOT_WS}")


def normalise_newlines(col) -> Column:
    """Text-mode read: CRLF and lone CR become LF."""
    return F.regexp_replace(_c(col), "\r\n?", "\n")


@lru_cache(maxsize=1)
def _deaccent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: NFD, drop combining marks, NFC.

    Built by rule over the Basic Multilingual Plane: a character maps to
    the one character it reduces to; combining marks map to nothing
    (they are listed last in ``from`` with no counterpart in ``to``).
    """
    src, dst, drop = [], [], []
    for cp in range(0x20, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            drop.append(ch)
            continue
        nfd = unicodedata.normalize("NFD", ch)
        if nfd == ch:
            continue
        out = unicodedata.normalize(
            "NFC", "".join(c for c in nfd if unicodedata.category(c) != "Mn"))
        if out != ch and len(out) == 1:
            src.append(ch)
            dst.append(out)
    return "".join(src) + "".join(drop), "".join(dst)


def deaccent(col) -> Column:
    """Strip accents the way ``unicodedata`` NFD + drop marks + NFC does."""
    frm, to = _deaccent_table()
    return F.translate(_c(col), frm, to)


def tokens_words(col, min_len: int = 2) -> Column:
    """Letters-only word tokens: lower case, whole word runs of ``[a-z]``.

    Equals ``(?u)\\b[a-zA-Z][a-zA-Z]+\\b`` on lower-cased text: a match
    bounded by word boundaries is exactly a maximal word run made of ASCII
    letters only.
    """
    runs = F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RUN), F.lit(0))
    return F.filter(runs, lambda t: t.rlike(f"^[a-z]{{{min_len},}}$"))


def tokens_lexicon(col) -> Column:
    """``\\b[a-z]+\\b`` on lower-cased text (single letters count)."""
    return tokens_words(col, min_len=1)


def tokens_normalised(col, min_len: int = 3, max_len: int = 15) -> Column:
    """Lower case, strip accents, alphabetic runs, length bounds, no leading _."""
    runs = F.regexp_extract_all(deaccent(F.lower(_c(col))), F.lit(ALPHA_RUN), F.lit(0))
    return F.filter(
        runs,
        lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len) & ~t.startswith("_"),
    )


def remove_words(tokens, words: list[str]) -> Column:
    """Order-preserving removal of listed words (an IN-set, hashed by Catalyst)."""
    if not words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(list(words)))


def keep_words(tokens, words: list[str]) -> Column:
    return F.filter(_c(tokens), lambda t: t.isin(list(words)))


def _bigrams(t: Column) -> Column:
    nxt = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = F.zip_with(t, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def bigrams(tokens) -> Column:
    """Adjacent pairs joined by one space, in order."""
    return once(tokens, _bigrams)


def ngrams_1_2(tokens) -> Column:
    """Unigrams followed by bigrams (scikit-learn ``ngram_range=(1, 2)``)."""
    return once(tokens, lambda t: F.concat(t, _bigrams(t)))


def sentences(col) -> Column:
    """Pieces of text between runs of full stops and newlines."""
    return F.split(_c(col), r"[.\n]+")


def preview_hover(col, n: int = 80) -> Column:
    """First n characters, newline -> space, '<' escaped, stripped, '...'."""
    cut = F.substring(_c(col), 1, n)
    cut = F.replace(F.replace(cut, F.lit("\n"), F.lit(" ")), F.lit("<"), F.lit("&lt;"))
    return F.concat(strip_ws(cut), F.lit("..."))


def preview_export(col, n: int = 200) -> Column:
    """Newline -> space, then the first n characters."""
    return F.substring(F.replace(_c(col), F.lit("\n"), F.lit(" ")), 1, n)


def series_of(col, prefixes, default: str) -> Column:
    """First matching prefix rule wins; otherwise the default label."""
    expr = None
    for prefix, label in prefixes:
        cond = _c(col).startswith(prefix)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.lit(default) if expr is None else expr.otherwise(default)


def join_top(sorted_structs, field: str, n: int, sep: str) -> Column:
    """Join ``field`` of the first n elements of an already sorted array."""
    return F.array_join(F.transform(F.slice(sorted_structs, 1, n), lambda s: s[field]), sep)
