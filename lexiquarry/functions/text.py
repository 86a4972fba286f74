"""Token-level column functions: normalising, splitting, special tokens, phrases.

All are Column -> Column and stay inside the JVM. ``\\w`` and ``\\b`` are taken over
Unicode letters and digits by explicit classes, as the engines differ there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiquarry.functions.stops import STOP_WORDS

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What separates tokens: white space and the signs that are never stored.
SEPARATORS = r"[\s\x{00A0}$^*@()/○•,?!;:`\]\[&]+"
#: What lies between two tokens: separators, with the punctuation that token ends lose.
_APART = SEPARATORS[1:-2]
_SIGNS = "".join("\\" + c for c in PUNCTUATION)
_INNER = "".join("\\" + c for c in PUNCTUATION if c not in "$^*@()/,?!;:`][&")
BETWEEN = f"[{_INNER}]*[{_APART}][{_APART}{_SIGNS}]*"
#: What no token begins or ends with.
ENDS = PUNCTUATION + " \t\n\x0b\f\r\u00a0○•"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
ESCAPES = (("&blank;", "&"), ("blank;", "&"), ("&cir;", "○"), ("&hyph;", "-"), ("&sect;", "§"), ("&times;", "×"), ("&racute;", "r"))
W = r"[\p{L}\p{N}_]"
#: Words with inner signs, or single signs.
PHRASE_TOKEN = r"[\p{L}\p{N}_]+(?:[-'.][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
PHRASE_SIGNS = tuple(", ( ) . ? ! ' ; ... : - @ $ ^ * / ○ • `` '' & [ ] % #".split())


def lines(text: Column) -> Column:
    """The non-empty lines of a text."""
    return F.filter(F.split(text, LINE_ENDS), lambda x: x != "")


def normalize(token: Column) -> Column:
    """Lower case, no commas, no punctuation at either end."""
    return F.btrim(F.replace(F.lower(token), F.lit(","), F.lit("")), F.lit(PUNCTUATION))


def decode_escapes(line: Column) -> Column:
    """Named escapes as signs, in lines that hold one at all."""
    out = line
    for name, sign in ESCAPES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.when(F.contains(line, F.lit("&")) & line.rlike("&[a-z]+;"), out).otherwise(line)


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Normalised tokens in order, stop words included; a token's place, from 1, is its position.

    These are the pieces between ``SEPARATORS``, each normalised; as the text is split where
    separators and the punctuation beside them lie, no token is looked at alone. Only a capital
    sigma's lower case depends on where the token ends.
    """
    cut = F.btrim(text, F.lit(ENDS))
    found = F.when(F.contains(cut, F.lit("Σ")), F.transform(F.split(cut, BETWEEN), F.lower)).otherwise(F.split(F.lower(cut), BETWEEN))
    return F.array_remove(found, "")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_stop(token: Column, stops=STOP_WORDS) -> Column:
    return token.isin(*stops)


def terms(text: Column, stops=STOP_WORDS) -> Column:
    """Normalised tokens that aren't stop words."""
    return F.filter(tokens(text), lambda t: ~is_stop(t, stops))


def phrase_tokens(line: Column) -> Column:
    """Lower-case tokens and signs of a line, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit(PHRASE_TOKEN), F.lit(0)), F.lower)


def phrase_flags(found: Column, stops=STOP_WORDS) -> Column:
    """For each token whether it may stand in a phrase."""
    return F.transform(found, lambda t: ~t.isin(*stops, *PHRASE_SIGNS))


def phrases(found: Column, ok: Column, last_start: int) -> Column:
    """Two- and three-word phrases; a window starts at least ``last_start`` tokens before the end.

    Documents use 3 (so a line's last pair is not a phrase), queries 2.
    """
    size = F.size(found)
    starts = F.when(size >= last_start, F.sequence(F.lit(0), size - last_start)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        def good(k: int) -> Column:
            return F.coalesce(F.get(ok, i + k), F.lit(False))

        pair = F.concat_ws(" ", F.get(found, i), F.get(found, i + 1))
        triple = F.concat_ws(" ", pair, F.get(found, i + 2))
        both = good(0) & good(1)
        return F.filter(F.array(F.when(both, pair), F.when(both & good(2), triple)), lambda p: p.isNotNull())

    return F.flatten(F.transform(starts, at))
