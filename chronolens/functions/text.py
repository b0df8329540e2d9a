"""Text functions: folding, tokens, query parsing, snippets, markup. All columns stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _marked() -> tuple[str, str]:
    """Letters with marks and the plain Latin letters under them; combining marks have none, and go."""
    pairs, marks = {}, [chr(c) for c in range(0x300, 0x370)]
    for c in range(0xC0, 0x2E80):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(0x300 <= ord(m) < 0x370 for m in d[1:]):
            pairs[chr(c)] = d[0]
    return "".join([*pairs, *marks]), "".join(pairs.values())


_MARKED, _PLAIN = _marked()
_FOLD = {ord(c): _PLAIN[i] if i < len(_PLAIN) else None for i, c in enumerate(_MARKED)}
TOKEN = r"[\p{L}\p{N}]+"

STOPWORDS = frozenset(
    """a about all also an and any are as at be been being but by can could did do does done down each every for from had has have having he her here
    him his how i if in into is it its just many may me might more most much must my no not of off on or other our out over own s same shall she
    should so some such t than that the their them then there these they this those to too under up us versus very vs was we were what when where
    which who whom whose why will with would you your""".split()
)


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters, as one character or as several. ASCII text has none to look for."""
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, _MARKED, _PLAIN)))


def fold_text(text: str) -> str:
    return text.translate(_FOLD).lower()


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; null text has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def query_tokens(text: str) -> list[str]:
    """Tokens of a query string; the driver's counterpart of ``tokens``."""
    import regex

    return regex.findall(TOKEN, fold_text(text))


def _trimmed(word: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", word)


def free_text_query(text: str) -> str | None:
    """A match expression for free text: words quoted, stopwords dropped unless all are, joined by OR, the last a prefix."""
    found = [w.replace('"', '""') for w in map(_trimmed, text.split()) if w]
    kept = [w for w in found if w.lower() not in STOPWORDS] or found
    if not kept:
        return None
    return " OR ".join(f'"{w}"' for w in kept) + "*"


def free_text_terms(text: str) -> list[tuple[list[str], bool]]:
    """(phrase tokens, is prefix) of each word that ``free_text_query`` keeps."""
    found = [w for w in map(_trimmed, text.split()) if w]
    kept = [w for w in found if w.lower() not in STOPWORDS] or found
    out = [(query_tokens(w), False) for w in kept]
    if out:
        out[-1] = (out[-1][0], True)
    return [(t, p) for t, p in out if t]


def phrase_query(text: str, prefix: bool = False) -> str | None:
    """A match expression for a mention: its words as one phrase."""
    found = [w.replace('"', '""') for w in map(_trimmed, text.split()) if w]
    return f'"{" ".join(found)}"' + "*" * prefix if found else None


def phrase_count(toks: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often a phrase of tokens occurs; its last token may be a prefix."""
    n = len(phrase)
    if n == 1:
        hit = (lambda x: x.startswith(phrase[0])) if prefix else (lambda x: x == F.lit(phrase[0]))
        return F.size(F.filter(toks, hit)).cast("long")
    # the array is an argument throughout: one that a lambda captured would be made again for every element
    hits = F.transform(toks, lambda x: x == F.lit(phrase[0]))
    for k, w in enumerate(phrase[1:], 1):
        last = prefix and k == n - 1
        then = F.transform(F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0))), lambda x: x.startswith(w) if last else x == F.lit(w))  # noqa: B023
        hits = F.zip_with(hits, then, lambda x, y: x & F.coalesce(y, F.lit(False)))
    return F.size(F.filter(hits, lambda x: x)).cast("long")


def strip_markup(text: Column) -> Column:
    """Without <...> and {...}, six entities decoded, trimmed."""
    out = F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


_PIECES = r"[\p{L}\p{N}\u0300-\u036f]+"


def snippet_text(text: str | None, phrase: str, prefix: bool = False, most: int = 14) -> str:
    """Up to ``most`` tokens around the first place where the phrase's tokens stand, that place in brackets, an ellipsis where text is cut.

    Tokens are found in the text as it is and compared folded, as hits are. Empty without a hit.
    """
    import regex

    want = query_tokens(phrase)
    found = [(m.start(), m.end(), f) for m in regex.finditer(_PIECES, text or "") if (f := fold_text(m[0]))]
    n = len(want)
    same = lambda i: all(x == w or prefix and k == n - 1 and x.startswith(w) for k, (w, (_, _, x)) in enumerate(zip(want, found[i : i + n])))
    at = next((i for i in range(len(found) - n + 1) if same(i)), None) if n else None
    if at is None:
        return ""
    lo = max(0, min(at - max(0, most - n) // 2, len(found) - most))
    hi = min(len(found), max(lo + most, at + n))
    a, z, x, y = found[lo][0] if lo else 0, found[hi - 1][1] if hi < len(found) else len(text), found[at][0], found[at + n - 1][1]
    return ("…" if lo else "") + text[a:x] + "[" + text[x:y] + "]" + text[y:z] + ("…" if hi < len(found) else "")


def snippet(text: Column, phrase: Column | str, prefix: bool = False, most: int = 14) -> Column:
    """``snippet_text`` of a column; for few rows, as samples are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([snippet_text(t, p, prefix, most) for t, p in zip(texts, phrases)], dtype=object)

    return run(text, F.lit(phrase) if isinstance(phrase, str) else phrase)


def cut(text: Column, most: int) -> Column:
    """At most so many characters, with a mark where some are missing."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def citations(text: Column) -> Column:
    """``[[cite:VIDEO:T0-T1]]`` markers as an array of (video_id, t0, t1); a marker may group several, split by ``;``."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[cite:([^\]]+)\]\]"), 1)
    each = F.flatten(F.transform(inner, lambda x: F.split(x, r"\s*;\s*")))
    good = F.filter(each, lambda x: x.rlike(r"^[^:]+:\d+(\.\d+)?-\d+(\.\d+)?$"))
    return F.transform(
        good,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([^:]+):", 1).alias("video_id"),
            F.regexp_extract(x, r":(\d+(?:\.\d+)?)-", 1).cast("double").alias("t0"),
            F.regexp_extract(x, r"-(\d+(?:\.\d+)?)$", 1).cast("double").alias("t1"),
        ),
    )


def option_letter(text: Column) -> Column:
    """The option A-H that an answer names, null if none."""
    found = F.regexp_extract(text, r"(?i)(?:answer|option)\s*(?:is|:)?\s*\(?([A-H])\b", 1)
    bare = F.regexp_extract(F.trim(text), r"^\(?([A-H])\)?[.):]?(?:\s|$)", 1)
    return F.nullif(F.upper(F.when(found != "", found).otherwise(bare)), F.lit(""))


def clock_secs(text: Column) -> Column:
    """Seconds of a time such as 1:02:03, 02:03 or 63."""
    part = F.transform(F.split(F.regexp_extract(text, r"((?:\d+:){0,2}\d+(?:\.\d+)?)", 1), ":"), lambda x: x.cast("double"))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a * 60 + x)
