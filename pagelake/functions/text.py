"""Tokens, guards, confidence and names as Column expressions; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and letter-like numbers: what a word is made of. With digits for n-grams.
LETTER, ALNUM = r"\p{L}\p{Nl}\p{No}", r"\p{L}\p{N}"
#: White space as the string methods of the reference's language see it.
SPACE = r"[\s\x1c-\x1f]"

# Phrases that signal uncertainty, each counted three times at most.
MARKERS = (
    "i'm not sure", "i am not sure", "it appears that", "it seems", "possibly", "perhaps", "unclear", "illegible", "unreadable", "cannot determine",
    "could not read", "not legible", "damaged text", "faded", "torn", "obscured", "[unclear]", "[illegible]", "[?]", "...",
)
# Accented letters that a clean-up may not introduce.
ACCENTS = "äöüÄÖÜßéèêàâçñ"
# Names of common language codes.
LANGUAGES = {"de": "German", "fr": "French", "en": "English", "it": "Italian", "ja": "Japanese", "ru": "Russian", "es": "Spanish", "pt": "Portuguese", "pl": "Polish", "nl": "Dutch", "la": "Latin"}


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{LETTER}]+"), F.lit(0))


def ngram_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{ALNUM}]+"), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def distinct_ratio(values: Column) -> Column:
    """Share of distinct values; 1 for none."""
    return F.when(F.size(values) == 0, 1.0).otherwise(F.size(F.array_distinct(values)) / F.size(values).cast("double"))


def ngrams(tokens: Column, n: int = 4) -> Column:
    """Every run of n tokens as a 64-bit hash of its tokens' hashes; none if there are fewer. Numbers are told apart faster than joined strings."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    # one element, so that the hashes are bound once
    return F.when(F.size(tokens) >= n, F.transform(F.array(hashes), grams)[0]).otherwise(F.array().cast("array<bigint>"))


def repetition_reason(text: Column, tokens: Column, rows: Column, min_lines: int = 20, max_unique: float = 0.3, n: int = 4, min_tokens: int = 40, max_distinct: float = 0.2, ratios: tuple[Column, Column] | None = None) -> Column:
    """Why a text looks like a decoding loop: 'empty', 'lines', 'ngrams' or null. tokens, rows: of the text; ratios of lines and n-grams, if known."""
    lines_, grams = ratios or (distinct_ratio(rows), distinct_ratio(ngrams(tokens, n)))
    return (
        F.when(is_blank(text), "empty")
        .when((F.size(rows) >= min_lines) & (lines_ < F.lit(max_unique)), "lines")
        .when((F.size(tokens) >= min_tokens) & (grams < F.lit(max_distinct)), "ngrams")
    )


def marker_count(text: Column) -> Column:
    low = F.lower(text)
    each = [F.least(F.lit(3), ((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")) for m in MARKERS]
    return sum(each[1:], each[0])


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def heuristic_score(markers: Column, n_words: Column) -> Column:
    """0 to 100 from marker density: 5 % and more give 0; truncated, in doubles."""
    density = markers.cast("double") / F.greatest(n_words, F.lit(1))
    return F.greatest(F.lit(0), (F.lit(100.0) * (F.lit(1.0) - density / F.lit(0.05))).cast("int"))


def overall_score(heuristic: Column, model: Column) -> Column:
    """60 : 40 with the model's own score; a failed call (null) counts as 50."""
    return (F.lit(0.6) * heuristic + F.lit(0.4) * F.coalesce(model, F.lit(50))).cast("int")


def tier(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence >= 80, "high").when(confidence >= 55, "medium").otherwise("low")


def letters_ratio(raw: Column, cleaned: Column) -> Column:
    count = lambda t: F.aggregate(words(t), F.lit(0), lambda a, w: a + F.length(w))
    return F.when(count(raw) == 0, 1.0).otherwise(count(cleaned) / count(raw).cast("double"))


def accents_introduced(raw: Column, cleaned: Column) -> Column:
    return cleaned.rlike(f"[{ACCENTS}]") & ~raw.rlike(f"[{ACCENTS}]")


_W, _T, _S = LETTER, ".!?:;", SPACE
_NOUN = rf"(?U)(?<![{_W}])(?<!\A)(?<!\A{_S})(?<!\A[{_T}])(?<!{_S}{_S})(?<!{_S}[{_T}])(?<![{_T}]{_S})\p{{IsUppercase}}[{_W}]{{3,}}"


def proper_nouns(text: Column) -> Column:
    """Capitalised words of four letters or more that don't start a sentence, each occurrence."""
    return F.regexp_extract_all(text, F.lit(_NOUN), F.lit(0))


def dropped_nouns(raw: Column, cleaned: Column) -> Column:
    """Sorted nouns that occur less often in the cleaned text."""
    a, b = proper_nouns(raw), proper_nouns(cleaned)
    times = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    return F.array_sort(F.filter(F.array_distinct(a), lambda x: times(a, x) > times(b, x)))


def structure_verdict(original: Column, structured: Column, a: Column, b: Column) -> Column:
    """struct<ok, words_deleted, first_difference> from the texts and their words a and b."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True).cast("int")
    same_size = F.size(a) == F.size(b)
    return F.struct(
        (~is_blank(structured) & same_size & (at == 0)).alias("ok"),
        F.when(is_blank(structured), 0).otherwise(F.abs(F.size(a) - F.size(b))).alias("words_deleted"),
        F.when(~is_blank(structured) & same_size & (at > 0), at).alias("first_difference"),
    )


def character_error_rate(reference: Column, said: Column) -> Column:
    """Edit distance per reference character, 1 at most; both empty: 0."""
    rate = F.least(F.lit(1.0), F.levenshtein(reference, said) / F.length(reference).cast("double"))
    return F.when(F.length(reference) == 0, F.when(F.length(said) == 0, 0.0).otherwise(1.0)).otherwise(rate)


def title_repeats(title: Column, share: float = 0.5) -> Column:
    """Whether one word makes up half of a title of three words or more."""
    low = F.transform(words(title), lambda w: F.lower(w))
    most = F.array_max(F.transform(F.array_distinct(low), lambda x: F.size(F.filter(low, lambda y: y == x))))
    return F.when(F.size(low) < 3, False).otherwise(most / F.size(low).cast("double") >= share)


def token_estimate(text: Column) -> Column:
    return (F.length(text) / F.lit(3.5)).cast("int")


def language_code(said: Column) -> Column:
    """The first of comma-separated codes, if it is up to three letters; else 'unknown'."""
    code = F.trim(F.split(F.lower(F.trim(said)), ",")[0])
    return F.when(code.rlike(r"^\p{L}{1,3}$"), code).otherwise("unknown")


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[code], code)


def safe_name(name: Column, fallback: str = "untitled") -> Column:
    """A single path segment: no separators or reserved characters, no outer blanks or dots, 120 characters at most."""
    clean = F.translate(F.coalesce(name, F.lit("")), '<>:"/\\|?*', "_________")
    clean = F.regexp_replace(clean, r"\A[ .]+|[ .]+\z", "")
    clean = F.left(F.trim(F.regexp_replace(clean, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(120))
    return F.when(clean == "", fallback).otherwise(clean)


def page_stem(title: Column, filename: Column, page: Column, mimetype: Column) -> Column:
    """<title>/<file>, with _pNNNN for a page of a PDF."""
    base = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"(?s)(?<=[^.])\.[^.]*\z", "")
    pdf = F.coalesce(mimetype == "application/pdf", F.lit(False)) | F.lower(filename).endswith(".pdf")
    stem = F.concat_ws("/", safe_name(title), safe_name(base, "page"))
    return F.when(pdf, F.concat(stem, F.lit("_p"), F.lpad((F.coalesce(page, F.lit(0)) + 1).cast("string"), 4, "0"))).otherwise(stem)


def slug(name: Column, limit: int = 80) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), r"^-+|-+$", ""), F.lit(limit))


def note_html(text: Column) -> Column:
    """A paragraph for each line, an empty one for an empty line."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(F.transform(F.split(out, "\n"), lambda x: F.when(x == "", "<p><br></p>").otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))), "")


def note_text(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def natural_key(name: Column) -> Column:
    """Sorts digit runs by value, however long, and the rest without case: their length goes before digits without leading zeros."""
    digits = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|[^\d]+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 9, "0"), digits(x))).otherwise(x))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_ilike(text: Column, pattern: Column) -> Column:
    """LIKE that folds ASCII letters only; % and _ in the pattern are wildcards, nothing escapes them."""
    safe = F.replace(ascii_lower(pattern), F.lit("\\"), F.lit("\\\\"))
    return F.call_function("like", ascii_lower(text), safe)


def fenced_json(said: Column) -> Column:
    """JSON text out of an answer that may wrap it in a code fence; null if it doesn't parse."""
    body = F.trim(F.regexp_replace(F.trim(said), r"(?s)\A```[A-Za-z]*\s*|\s*```\z", ""))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def rotation_code(osd: Column) -> Column:
    """Orientation code from a detector's report: 90, 180 and 270 degrees give 6, 3 and 8, 0 and others null."""
    degrees = F.regexp_extract(osd, r"(?m)^Rotate:\s*(\d+)", 1)
    return F.create_map(*[F.lit(x) for x in ("90", 6, "180", 3, "270", 8)])[degrees]


def positive_int(value: Column) -> Column:
    """A natural number, or null for anything else."""
    number = value.try_cast("int")
    return F.when(number > 0, number)
