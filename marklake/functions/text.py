"""Text rules as native column expressions: normalization, tokens, stems, overlap, headers, splitting."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import NEGATORS, STOPWORDS, SUFFIXES

Arg = Column | str


def col(c: Arg) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks and the letters they stand on."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(point):
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(c: Arg) -> Column:
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize(c: Arg) -> Column:
    """Lower case, no accents, only letters, digits, ``/ . _ -`` and single spaces; null becomes empty."""
    kept = F.regexp_replace(strip_accents(F.lower(F.trim(F.coalesce(col(c), F.lit(""))))), r"[^a-z0-9\s/._-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_py(text: str | None) -> str:
    """The same on the driver, for lexicons and headers."""
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").strip().lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s/._-]", " ", plain)).strip()


def words(norm: Arg) -> Column:
    """Words of a normalized text."""
    return F.filter(F.split(col(norm), " "), lambda t: t != "")


def tokens(norm: Arg) -> Column:
    """Words of a normalized text that carry meaning: of three letters or more, no stopwords."""
    return F.filter(F.split(col(norm), " "), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


# A suffix within another stands after it in the list, so the first that fits is the longest: one expression
# with the shortest prefix of five letters or more finds it.
STEM = f"^(.{{5,}}?)(?:{'|'.join(SUFFIXES)})$"


def stem(token: Arg) -> Column:
    """The token without the first suffix that fits and leaves more than four letters."""
    return F.regexp_replace(col(token), STEM, "$1")


def stems(token_array: Arg) -> Column:
    return F.transform(col(token_array), stem)


def stem_py(token: str) -> str:
    return next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) > len(s) + 4), token)


def tokens_py(norm: str) -> list[str]:
    return [t for t in norm.split(" ") if len(t) > 2 and t not in STOPWORDS]


def overlap(answer_stems: Arg, target_stems: Arg) -> Column:
    """0 to 100: the share of the target's stems in the answer, and of the smaller set; 0 if one is empty."""
    a, t = F.array_distinct(col(answer_stems)), F.array_distinct(col(target_stems))
    both, na, nt = F.size(F.array_intersect(a, t)), F.size(a), F.size(t)
    score = F.round((F.lit(0.7) * both / nt + F.lit(0.3) * both / F.greatest(F.lit(1), F.least(na, nt))) * F.lit(100.0)).cast("int")
    return F.when((na == 0) | (nt == 0), F.lit(0)).otherwise(score)


def length_profile(token_array: Arg) -> Column:
    n = F.size(col(token_array))
    return F.when(n == 0, "empty").when(n <= 3, "brief").when(n <= 8, "short").otherwise("developed")


def negated(answer_norm: Arg, target_stems: Arg, window: int = 4) -> Column:
    """Whether a negator stands at most ``window`` words before a stem of the target, or is one."""
    neg = F.array(*[F.lit(n) for n in NEGATORS])

    def step(state: Column, t: Column) -> Column:
        """Position, that of the last negator, and whether a target was within reach of one."""
        root = stem(t)
        last = F.when(F.array_contains(neg, t) | F.array_contains(neg, root), state["i"]).otherwise(state["last"])
        hit = F.array_contains(col(target_stems), root) & (state["i"] - last <= window)
        return F.struct((state["i"] + 1).alias("i"), last.alias("last"), (state["hit"] | hit).alias("hit"))

    begin = F.struct(F.lit(0).alias("i"), F.lit(-window - 1).alias("last"), F.lit(False).alias("hit"))
    near = F.aggregate(words(answer_norm), begin, step, lambda s: s["hit"])
    return F.when(F.size(col(target_stems)) == 0, F.lit(False)).otherwise(F.coalesce(near, F.lit(False)))


def header(c: Arg) -> Column:
    """A column header in its canonical form."""
    return F.translate(F.replace(normalize(c), F.lit(" "), F.lit("")), "-.", "__")


def header_py(name: str) -> str:
    return normalize_py(str(name)).replace(" ", "").replace("-", "_").replace(".", "_")


def first_number(c: Arg) -> Column:
    return F.regexp_extract(col(c), r"(\d+)", 1)


def slug(c: Arg, fallback: str) -> Column:
    """A file name of at most 80 letters out of any text."""
    s = F.regexp_replace(F.regexp_replace(strip_accents(F.coalesce(col(c), F.lit(""))), r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(F.lower(s), 1, 80), F.lit("")), F.lit(fallback))


def split_values(c: Arg) -> Column:
    """The entries of a packed cell: parted by ; / | and line ends, and by commas unless it holds pairs with
    a colon; bullets and numbers before an entry are taken off."""
    text = F.regexp_replace(F.translate(F.trim(F.coalesce(col(c), F.lit(""))), "•·", "\n\n"), r"(?i)\s+y\s+", ";")
    parts = F.when(F.contains(text, F.lit(":")), F.split(text, r"\s*[;\n/|]\s*")).otherwise(F.split(text, r"\s*[;\n/|,]\s*"))
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*[-–—\d).]+\s*", "")))
    return F.filter(bare, lambda p: p != "")


def any_phrase(norm: Arg, phrases: list[str]) -> Column:
    """Whether a normalized text holds one of the phrases, as part of words too."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(col(norm), F.lit(p))
    return out


def labels(norm: Arg, *maps: dict[str, list[str]]) -> Column:
    """The sorted labels of the maps that have a phrase in the text."""
    found = {}
    for m in maps:
        for label, phrases in m.items():
            found.setdefault(label, []).extend(phrases)
    return F.array_compact(F.array(*[F.when(any_phrase(norm, p), F.lit(label)) for label, p in sorted(found.items())]))
