"""Text functions as column expressions: tokenisers, accent folding, k-grams, phonetic codes, set overlaps."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nine words that the relevance tokenisers drop.
RELEVANCE_STOP_WORDS = ("para", "con", "sin", "por", "del", "las", "los", "una", "uno")
#: Letters with marks and what folding leaves of them.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ir_tokens(text: Column) -> Column:
    """T_ir: lower-case runs of a-z, 0-9, # - + /; other letters split words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9#\-\+/]+"), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without marks; letters that have no plain form go."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^\\x00-\\x7f]", "")


@functools.cache
def _marks() -> tuple[str, str]:
    """All characters that change when marks are taken off, and what is left; marks themselves stand at the end of the first."""
    plain, marks = {}, []
    for c in map(chr, range(0x80, 0x2FA20)):
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
        elif unicodedata.decomposition(c)[:1] not in ("", "<"):
            left = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))
            if left != c:
                plain[c] = left
    marks += map(chr, range(0xE0100, 0xE01F0))
    return "".join(plain) + "".join(marks), "".join(plain.values())


def unmarked(text: Column) -> Column:
    """Lower case without marks, as SQL takes them off: letters that have no plain form stay, so that what stands beside them doesn't meet."""
    return F.lower(F.translate(text, *_marks()))


def ml_tokens(text: Column) -> Column:
    """T_ml: folded runs of three or more a-z, 0-9, repeats kept."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]{3,}"), F.lit(0))


def relevance_list(text: Column) -> Column:
    """T_x: lower-case runs of three or more a-z, 0-9 without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*RELEVANCE_STOP_WORDS))


def relevance_set(text: Column) -> Column:
    """T_rel: the distinct tokens of T_x."""
    return F.array_distinct(relevance_list(text))


def context_set(text: Column) -> Column:
    """T_ctx: distinct folded runs of more than two a-z, 0-9."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))


def word_set(text: Column, longer_than: int = 3) -> Column:
    """T_ws: white-space words without punctuation at their ends, longer than so many characters."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


def kgrams(term: Column, k: int = 3) -> Column:
    """Distinct k-grams of a term between two $."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(k))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays taken as sets; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def edit_distance(a: Column, b: Column, cutoff: int) -> Column:
    """Levenshtein distance, cutoff + 1 beyond the cutoff."""
    d = F.levenshtein(a, b, cutoff)
    return F.when(d < 0, cutoff + 1).otherwise(d)


def soundex_strict(word: Column) -> Column:
    """A Soundex in which every letter without a code, h and w included, ends a run of equal codes; marks are folded."""
    letters = F.regexp_replace(F.upper(fold(word)), "[^A-Z]", "")
    codes = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    once = F.regexp_replace(codes, r"(.)\1+", "$1")
    tail = F.regexp_replace(F.substring(once, F.lit(2), F.length(once)), "0", "")
    return F.when(F.length(letters) == 0, "").otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), tail), 4, "0"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def overlap_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the shares of two sets that they have in common."""
    # one division of whole numbers: of the shares' quotient, .1 can come out below .1
    return F.coalesce(2 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0))


def canonical_url(url: Column) -> Column:
    """G1: http(s) only; lower-case scheme and host, no fragment, ;parameters, closing slash or tracking parameters."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid)(=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail))
