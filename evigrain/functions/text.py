"""Text functions as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# Transliteration of Russian letters for ids.
LETTERS = ("абвгдезийклмнопрстуфыэё", "abvgdezijklmnoprstufyee")
DIGRAPHS = {"ж": "zh", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def fold(c: Column, yo: bool = False) -> Column:
    """White space to single spaces, trimmed, lower case; with ``yo`` also ё to е."""
    out = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.translate(out, "ё", "е") if yo else out


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


# Words that carry no meaning of their own, and endings that inflect.
STOP_WORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"),
    "ru": ("и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за", "бы", "по", "от", "из", "о", "для", "до", "или", "при", "их", "это", "этот", "мы"),
}
ENDINGS = {"en": "ings?|edly|ied|ies|ed|es|s|ly", "ru": "иями|ями|ами|ого|его|ому|ему|ыми|ими|ая|яя|ое|ее|ые|ие|ой|ей|ом|ем|ам|ям|ах|ях|ов|ев|ию|ью|ия|ья|ый|ий|а|я|о|е|ы|и|у|ю|ь"}


def stemmed(c: Column) -> Column:
    """Words without stop words, cut before the longest inflecting ending that leaves three letters."""
    stops = [w for ws in STOP_WORDS.values() for w in ws]
    kept = F.filter(words(c), lambda w: ~w.isin(stops))
    return F.transform(kept, lambda w: F.regexp_replace(F.regexp_replace(w, rf"^([a-z]{{3,}}?)(?:{ENDINGS['en']})$", "$1"), rf"^([а-яё]{{3,}}?)(?:{ENDINGS['ru']})$", "$1"))


def slug(c: Column, size: int = 40) -> Column:
    """Letters and digits in Latin script, joined by ``_``, of at most ``size`` signs."""
    out = F.translate(F.lower(c), *LETTERS)
    for a, b in DIGRAPHS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(out, "^_+|_+$", ""), 1, size), "_+$", "")


def count_of(c: Column, pattern: str) -> Column:
    """How many signs match a character class."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def script_language(c: Column, high: float = 0.7, low: float = 0.15, least: int = 20) -> Column:
    """``ru``, ``en`` or ``mixed`` by the share of Cyrillic among letters; short texts are ``ru``."""
    cyr, lat = count_of(c, "[а-яёА-ЯЁ]"), count_of(c, "[a-zA-Z]")
    share = cyr / (cyr + lat)
    return F.when(cyr + lat < least, "ru").when(share >= high, "ru").when(share <= low, "en").otherwise("mixed")


def query_language(c: Column) -> Column:
    """A query is ``mixed`` when it has Cyrillic and more than 0.4 times as many Latin letters."""
    cyr, lat = count_of(c, "[а-яёА-ЯЁ]"), count_of(c, "[a-zA-Z]")
    return F.when((cyr > 0) & (lat > 0) & (lat > 0.4 * cyr), "mixed").when(lat > cyr, "en").otherwise("ru")


def token_estimate(c: Column, per_token: float = 3.5) -> Column:
    """Estimated tokens, 1 at least; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / F.lit(per_token)).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two words, by bisection over a short sequence."""
    n = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(a, k) == F.left(b, k))
    return F.array_max(fits)


def same_word(a: Column, b: Column) -> Column:
    """Equal but for inflection: prefix of 5 and tails of 2 at most, in short words prefix of 3 and tails of 1."""
    p = common_prefix(a, b)
    tails = F.greatest(F.length(a), F.length(b)) - p
    short = F.least(F.length(a), F.length(b)) < 6
    return (a == b) | F.when(short, (p >= 3) & (tails <= 1)).otherwise((p >= 5) & (tails <= 2))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?;])\s+")


def plain_citations(c: Column) -> Column:
    """Citation marks in square brackets, whatever brackets they came in."""
    return F.regexp_replace(c, r"【\s*(\d+)\s*】", "[$1]")


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quote is in a text, up to white space and case; or at least its first 10, 8 or 6 words."""
    q, t = fold(quote), fold(text)
    parts = F.split(q, " ")
    head = lambda n: (F.size(parts) >= n) & F.contains(t, F.array_join(F.slice(parts, 1, n), " "))
    return (F.length(q) > 0) & (F.contains(t, q) | head(10) | head(8) | head(6))


def contents_page(c: Column) -> Column:
    """Tables of contents: five lines or more with dot leaders, over half of all lines."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)
    led = F.size(F.filter(lines, lambda x: x.rlike(r"\.{4,}\s*\d*\s*$")))
    return (F.size(lines) == 0) | ((led >= 5) & (led / F.size(lines) > 0.5))
