"""Column expressions over text: script, metrics, cleaning, keys, tokens. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, thresholds and word lists of the default profile.
ARABIC = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"
LANGUAGE = "\\p{L}\\p{M}\\p{N}\\p{P}\\x{0600}-\\x{060F}"
SPACES = "\\s\\x{00A0}\\x{2007}\\x{202F}"
STRICT = {"min_chars": 200, "min_words": 25, "min_script": 0.70, "max_other": 0.06, "max_repeat": 0.60, "max_corrupt": 0.005}
PERMISSIVE = {"min_chars": 60, "min_words": 8, "min_script": 0.45, "max_other": 0.25, "max_repeat": 0.90, "max_corrupt": 0.05}
HINDKO_TOKENS = (
    "دا", "دی", "دے", "نال", "اچ", "سی", "کیہڑی", "اوہ", "پئے", "ہوسی", "جانڑیں", "برانڑیں",
    "ہک", "ہوندے", "جاوے", "ائی", "جدو", "اناں", "طراں", "تے", "کیتا", "ائے", "انہاں", "صیب", "کردے", "آپڑے", "آں", "ہوندی", "ہووے",
    "وخت", "آپڑی", "ایا", "جاندے", "وے", "پشور", "بچ", "دیاں", "وسے", "کیتی", "ہوندا", "وسطے", "ون", "نوں", "ہونڑے", "اپڑے", "اپڑی",
    "جاندی", "توں", "ای", "جاندا", "ساڈے", "جیہڑا", "لوکاں",
)
URDU_TOKENS = (
    "کا", "کی", "کے", "سے", "ہے", "جس", "لئے", "گیا", "تھا", "تھی", "ہیں", "رہا", "رہی", "کیا", "ہوئی",
    "ہمارے", "ہوتے", "جب", "تھے", "اپنی", "وہ", "کیلئے", "جائے", "ایک", "لوگوں", "یہ", "ساتھ", "اپنے", "آج", "ہونے", "کہا", "مجھے",
    "یہاں", "بات", "اور", "کرتا", "جیسے", "اسے", "جاتا", "انہوں", "کبھی", "سامنے", "جاتے", "کرتے", "انہیں", "گا", "جاتی", "کام", "اپنا",
    "ہوتا", "نہیں", "ہوں", "ہوتی", "کئے", "زبانوں", "بنا", "وہاں", "دیا",
)
HINDKO_MIN, URDU_MAX = 0.70, 0.30
AD_WORDS = (
    "اشتہار", "تشہیر", "فری ہوم ڈلیوری", "آرڈر کریں", "ابھی آرڈر", "خصوصی رعایت", "رعایت", "مکان فروخت", "کرایہ پر دستیاب", "درکار",
    "call now", "order now", "free home delivery", "discount",
)
PLACES = ("ترنوالہ", "سرکھیت", "ہلکوٹ", "کوٹ زریاب", "بن سیری", "مورتہ خورد", "نیلاں والی", "ڈھیری موڑا")
DESKS = ("نیوز", "رپورٹر", "نامہ نگار", "ویب ڈیسک")
PHONE = r"(\+?92|0)?3[0-9]{2}[\s\-]?[0-9]{7}"
URL = r"(https?://|www\.)\S+"
HARD = ("empty", "too_short", "too_few_words", "low_script_fraction", "excess_non_language", "excessive_repetition", "corrupt_glyphs", "advertisement")

#: Text folded letter by letter: (from, to).
LEAK_FROM, LEAK_TO = "يىكهةۃە٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ییکہہہہ01234567890123456789"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression is computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def script_fraction(c: Column, script: str = ARABIC) -> Column:
    """Characters of the script among those that aren't spaces; 0 for none."""
    return let(F.regexp_replace(c, r"\s+", ""), lambda x: ratio(F.length(x) - F.length(F.regexp_replace(x, f"[{script}]+", "")), F.length(x), 0.0))


def non_language_ratio(c: Column) -> Column:
    """Share of non-space characters that are no letter, mark, number or punctuation; 1 for an empty text."""
    return let(F.regexp_replace(c, r"\s+", ""), lambda x: ratio(F.length(F.regexp_replace(x, f"[{LANGUAGE}]+", "")), F.length(x), 1.0))


def corrupt_ratio(c: Column) -> Column:
    """Replacement characters among those that aren't spaces: what a decoder couldn't map."""
    return let(F.regexp_replace(c, r"\s+", ""), lambda x: ratio(F.length(x) - F.length(F.replace(x, F.lit("\ufffd"), F.lit(""))), F.length(x), 0.0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def max_line_repeat(c: Column) -> Column:
    """Largest share of one line among a text's lines; 0 for fewer than two lines."""


    def share(ls: Column) -> Column:
        # Sorted equal lines stand together: the state is (last line, its count, best count).
        start = F.struct(F.lit("").alias("l"), F.lit(0).alias("n"), F.lit(0).alias("m"))

        def step(a: Column, x: Column) -> Column:
            n = F.when(x == a["l"], a["n"] + 1).otherwise(1)
            return F.struct(x.alias("l"), n.alias("n"), F.greatest(a["m"], n).alias("m"))

        most = F.aggregate(F.array_sort(ls), start, step, lambda a: a["m"])
        return F.when(F.size(ls) >= 2, most / F.size(ls)).otherwise(F.lit(0.0))

    return let(lines(c), share)


def normalize_invisible(c: Column) -> Column:
    """Control, zero-width and direction characters dropped; the zero-width non-joiner stays."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{200b}\\x{200d}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]", "")


def clean_text(c: Column) -> Column:
    """Ordered repairs: invisible characters, residue, kashida, spaces, repeated and spaced punctuation, page numbers."""
    x = F.regexp_replace(normalize_invisible(c), "\\r\\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "[_|~`{}<>\\\\]", ""), "\\x{0640}+", "")
    x = F.regexp_replace(x, "[ \\t\\x{00a0}\\x{2007}\\x{202f}]+", " ")
    x = F.regexp_replace(x, "([،۔؛:!؟?.\\-—–])\\1{2,}", "$1$1")
    x = F.regexp_replace(x, "[ \\t]+([،۔؛:!؟?.)\\]…])", "$1")
    x = F.regexp_replace(x, "\\(\\s+", "(")
    kept = F.filter(lines(x), lambda l: ~l.rlike("^[0-9۰-۹]{1,4}$"))
    return F.array_join(kept, "\n")


def is_content_line(l: Column) -> Column:
    solid = F.length(F.regexp_replace(l, r"\s", ""))
    return (count(l, f"[{ARABIC}]") >= 4) & (F.length(F.regexp_replace(l, r"^\s+|\s+$", "")) >= 12) & ~((solid > 200) & (script_fraction(l) < 0.30))


def is_valid_title(c: Column) -> Column:
    return F.length(c).between(20, 160) & ~c.rlike(r"[A-Za-z_|@~`{}\[\]<>=+*#$%^&\\]") & (script_fraction(c) >= 0.80)


def is_dateline(c: Column, places: tuple[str, ...], desks: tuple[str, ...]) -> Column:
    """A line that opens with a place, or with any name and a news desk in brackets."""
    p = "|".join(places)
    return c.rlike(rf"^({p})\s*[(،,]") | c.rlike(rf"^[^\s()،,]{{2,24}}\([^)]*({'|'.join(desks)})[^)]*\)")


def looks_like_ad(c: Column) -> Column:
    """Commercial intent: a phone number and an advertising word, or a link and two, or three; no text that opens with a
    dateline."""
    opens = F.regexp_extract(F.regexp_replace(c, r"^\s+", ""), r"^[^\n]*", 0)


    def test(low: Column) -> Column:
        hits = sum((low.contains(w).cast("int") for w in AD_WORDS), F.lit(0))
        # The counts are cheap; the patterns run on the few texts that have an advertising word at all.
        return let(hits, lambda h: ((h >= 3) | ((h >= 1) & c.rlike(PHONE)) | ((h >= 2) & c.rlike("(?i)" + URL))) & ~is_dateline(opens, PLACES, DESKS))

    return let(F.lower(c), test)


def gate(c: Column, ad: Column) -> Column:
    """(r, tier): codes of the failed thresholds, in fixed order and for each metric at most the harder one, and the
    tier they give. Every metric is computed once per row."""
    s, p = STRICT, PERMISSIVE
    metrics = F.struct(F.length(c).alias("n"), word_count(c).alias("w"), script_fraction(c).alias("sf"), non_language_ratio(c).alias("nl"), max_line_repeat(c).alias("rep"), corrupt_ratio(c).alias("bad"), ad.alias("ad"))

    def two(hard: Column, hard_code: str, soft: Column, soft_code: str) -> Column:
        return F.when(hard, F.lit(hard_code)).when(soft, F.lit(soft_code))

    def reasons(m: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(m["n"] == 0, F.lit("empty")),
                two(m["n"] < p["min_chars"], "too_short", m["n"] < s["min_chars"], "below_strict_length"),
                two(m["w"] < p["min_words"], "too_few_words", m["w"] < s["min_words"], "below_strict_words"),
                two(m["sf"] < p["min_script"], "low_script_fraction", m["sf"] < s["min_script"], "below_strict_script_fraction"),
                two(m["nl"] > p["max_other"], "excess_non_language", m["nl"] > s["max_other"], "below_strict_non_language"),
                two(m["rep"] > p["max_repeat"], "excessive_repetition", m["rep"] > s["max_repeat"], "below_strict_repetition"),
                two(m["bad"] > p["max_corrupt"], "corrupt_glyphs", m["bad"] > s["max_corrupt"], "below_strict_glyph_purity"),
                F.when(m["ad"], F.lit("advertisement")),
            )
        )

    return let(let(metrics, reasons), lambda r: F.struct(r.alias("r"), tier(r).alias("tier")))


def tier(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "strict").when(F.arrays_overlap(reasons, F.array(*(F.lit(h) for h in HARD))), "reject").otherwise("permissive")


def tokens(c: Column) -> Column:
    """Tokens between spaces, punctuation and digits, harakat stripped."""
    bare = F.regexp_replace(c, "[\\x{064B}-\\x{065F}\\x{0670}]", "")
    return F.filter(F.split(bare, "[\\s،؛؟۔.,:;!?()\\[\\]\"'‘’“”/\\-_*…0-9۰-۹٠-٩\\x{FFFD}]+"), lambda t: t != "")


def marker_hits(c: Column, markers: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens(c), lambda t: t.isin(*markers)))


def marker_score(h: Column, u: Column) -> Column:
    return F.when(h + u == 0, F.lit(0.5)).otherwise(h / (h + u))


def variety(h: Column, u: Column) -> Column:
    s = marker_score(h, u)
    return F.when(h + u == 0, "no_signal").when(s >= HINDKO_MIN, "hindko").when(s <= URDU_MAX, "urdu").otherwise("mixed")


def leak_fold(c: Column) -> Column:
    """Marks, format characters and kashida dropped, letter forms and digits made one, lower case."""
    return F.lower(F.translate(F.regexp_replace(c, "[\\p{Mn}\\p{Me}\\p{Cf}\\x{0640}]", ""), LEAK_FROM, LEAK_TO))


def leak_words(c: Column) -> Column:
    return F.regexp_extract_all(leak_fold(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def ngrams(ws: Column, n: int) -> Column:
    """Runs of n words, joined by a space; none for shorter texts."""
    none = F.array().cast("array<string>")
    return let(ws, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def gram_hashes(ws: Column, n: int) -> Column:
    """Hashes of all runs of n words, without making strings of them; none for shorter texts."""
    none = F.array().cast("array<bigint>")
    return let(ws, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(none))


def array_distinct_sized(c: Column) -> Column:
    """The distinct elements of an array as (gram, n), n their number, so that the number survives an explosion."""
    return let(F.array_distinct(c), lambda a: F.transform(a, lambda x: F.struct(x.alias("gram"), F.size(a).alias("n"))))


def char_shingles(c: Column, k: int = 5) -> Column:
    """Distinct windows of k characters of the text without spaces; a shorter text is its own."""
    none = F.array().cast("array<string>")

    def cut(x: Column) -> Column:
        # Slices of an array of characters take constant time, positions in a string don't.
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(x) - k + 1), lambda i: F.array_join(F.slice(x, i, k), "")))
        return F.when(F.size(x) >= k, many).when(F.size(x) > 0, F.array(F.array_join(x, ""))).otherwise(none)

    return let(F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda ch: ch != ""), cut)


def line_key(c: Column) -> Column:
    """A line with its spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def canonical_url(c: Column) -> Column:
    """No scheme, www, default port, fragment or closing slash; lower case."""
    x = F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"^https?://(www\.)?", "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"^([^/:]+):(80|443)(/|$)", "$1$3"), r"/+$", ""))


def replace_range(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)
