"""Queries on page texts: guards, confidence, repair, names, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions import udf as U
from pagelake.functions.repair import LOWER, PREFIXES, UPPER, repair
from pagelake.plans.registry import query, read

_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{Nl}}\p{{No}}]+')"
_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"
_STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_MARK = "least(3, (length(lower({t})) - length(replace(lower({t}), '{m}', ''))) // {n})"
_MARKERS = " + ".join(_MARK.format(t="text", m=m.replace("'", "''"), n=len(m)) for m in T.MARKERS)
_N_WORDS = r"len(regexp_extract_all(text, '[^\s\x1c-\x1f]+'))"
_HEUR = "greatest(0, CAST(trunc(100.0::DOUBLE * (1.0::DOUBLE - (m::DOUBLE / greatest(n, 1)) / 0.05::DOUBLE)) AS INTEGER))"
_TIER = "CASE WHEN {c} IS NULL THEN 'none' WHEN {c} >= 80 THEN 'high' WHEN {c} >= 55 THEN 'medium' ELSE 'low' END"

_SCORED = f"scored AS (SELECT *, {_HEUR} AS score FROM (SELECT doc_id, source, lang, {_MARKERS} AS m, {_N_WORDS} AS n FROM d))"
_GUARDED = f"""guarded AS (SELECT doc_id, source, len(rows) AS n_lines, len(toks) AS n_tokens, blank,
 CASE WHEN len(rows) = 0 THEN 1.0 ELSE len(list_distinct(rows)) / len(rows)::DOUBLE END AS line_ratio,
 CASE WHEN len(toks) < 4 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, len(toks) - 2), lambda i: array_to_string(toks[i:i+3], ' ')))) / (len(toks) - 3)::DOUBLE END AS gram_ratio
 FROM (SELECT doc_id, source, {_LINES} AS rows, {_TOKENS.format("text")} AS toks, NOT regexp_matches(text, '[^\\s\\x1c-\\x1f]') AS blank FROM d)),
verdict AS (SELECT *, CASE WHEN blank THEN 'empty' WHEN n_lines >= 20 AND line_ratio < 0.3::DOUBLE THEN 'lines' WHEN n_tokens >= 40 AND gram_ratio < 0.2::DOUBLE THEN 'ngrams' END AS reason FROM guarded)"""
#: Texts that also carry markers and loops, made the same way in both engines.
_D = "d AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' [unclear] perhaps torn ... ' WHEN doc_id % 41 = 3 THEN repeat('one more line' || chr(10), 30) WHEN doc_id % 43 = 4 THEN repeat('the same four words again ', 40) WHEN doc_id % 97 = 5 THEN ' ' ELSE coalesce(text, '') END AS text FROM documents)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    marked = F.when(i % 5 == 0, F.concat(text, F.lit(" [unclear] perhaps torn ... "))).when(i % 41 == 3, "one more line\n" * 30).when(i % 43 == 4, "the same four words again " * 40).when(i % 97 == 5, " ")
    return d.select("doc_id", "source", "lang", marked.otherwise(text).alias("text"))


def _judged(d: DataFrame) -> DataFrame:
    p = d.select("*", T.lines(F.col("text")).alias("rows"), T.ngram_tokens(F.col("text")).alias("toks"))
    p = p.withColumns({"line_ratio": T.distinct_ratio(F.col("rows")), "gram_ratio": T.distinct_ratio(T.ngrams(F.col("toks")))})
    return p.withColumn("reason", T.repetition_reason(F.col("text"), F.col("toks"), F.col("rows"), ratios=(F.col("line_ratio"), F.col("gram_ratio"))))


def _confident(d: DataFrame) -> DataFrame:
    p = d.withColumns({"markers": T.marker_count(F.col("text")), "n_words": T.word_count(F.col("text"))})
    return p.withColumn("score", T.heuristic_score(F.col("markers"), F.col("n_words")))


@query(f"""WITH {_D}, {_SCORED}, {_GUARDED}
SELECT s.source, count(*) AS n_docs, count(reason) AS rejected, avg(score) AS avg_score, count(*) FILTER (score >= 80) AS high, count(*) FILTER (score >= 55 AND score < 80) AS medium, count(*) FILTER (score < 55) AS low
FROM scored s JOIN verdict v USING (doc_id) GROUP BY s.source""")
def page_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _confident(_judged(_pages(spark, sf_dir))).select("source", "reason", "score", T.tier(F.col("score")).alias("tier"))
    mix = [F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")]
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("reason").alias("rejected"), F.avg("score").alias("avg_score"), *mix)


@query(f"WITH {_D}, {_GUARDED} SELECT doc_id, reason IS NULL AS ok, reason, line_ratio, gram_ratio FROM verdict")
def guard_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(_pages(spark, sf_dir)).select("doc_id", F.col("reason").isNull().alias("ok"), "reason", "line_ratio", "gram_ratio")


@query(f"""WITH {_D}, l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM d),
c AS (SELECT doc_id, line, count(*) AS n, min(i) AS first FROM l GROUP BY ALL)
SELECT doc_id, arg_max(line, n * 1000000 - first) AS worst_line, max(n) AS repeats, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_distinct FROM c GROUP BY doc_id""")
def most_repeated_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    c = rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    return c.groupBy("doc_id").agg(F.max_by("line", F.struct(F.col("n"), -F.col("first"))).alias("worst_line"), F.max("n").alias("repeats"), F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"))


@query(f"WITH {_D}, {_SCORED} SELECT doc_id, CAST(m AS INTEGER) AS markers, score, {_TIER.format(c='score')} AS tier FROM scored")
def heuristic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confident(_pages(spark, sf_dir)).select("doc_id", "markers", "score", T.tier(F.col("score")).alias("tier"))


@query(f"""WITH {_D}, {_SCORED} SELECT doc_id, CAST(trunc(0.6::DOUBLE * score + 0.4::DOUBLE * coalesce(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 101 END, 50)) AS INTEGER) AS overall FROM scored""")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 101)
    return _confident(_pages(spark, sf_dir)).select("doc_id", T.overall_score(F.col("score"), model).alias("overall"))


@query(f"WITH {_D}, {_SCORED} SELECT lang, {_TIER.format(c='(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE score END)')} AS tier, count(*) AS n FROM scored GROUP BY ALL")
def confidence_tier_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _confident(_pages(spark, sf_dir)).withColumn("tier", T.tier(F.when(F.col("doc_id") % 9 != 0, F.col("score"))))
    return p.groupBy("lang", "tier").agg(F.count(F.lit(1)).alias("n"))


_WORN_SQL = "replace(replace(replace(replace(replace(CASE WHEN doc_id % 11 = 0 THEN '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) ELSE '' END || text, ' the ', ' the  '), 'ion', 'i-' || chr(10) || 'on'), ', ', ' , '), ' of ', ' self-' || chr(10) || 'of—' || chr(10) || ' '), ' and ', ' and' || chr(10) || 'North-' || chr(13) || chr(10) || 'West ')"


def _worn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the artifacts that repairs undo, made the same way in both engines."""
    text = F.concat(F.when(F.col("doc_id") % 11 == 0, "---\na: b\n---\n").otherwise(""), F.coalesce("text", F.lit("")))
    for a, b in ((" the ", " the  "), ("ion", "i-\non"), (", ", " , "), (" of ", " self-\nof—\n "), (" and ", " and\nNorth-\r\nWest ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _repair_sql() -> str:
    letters, gap = LOWER + UPPER, r" *\r?\n *"
    # no lookbehind here: the character before a prefix is captured instead
    rules = (
        ("hyphen_prefix_keep", rf"(^|[^{letters}])({'|'.join(PREFIXES)})-{gap}([{LOWER}][{letters}]*)", r"\1\2-\3", "gi"),
        ("hyphen_rejoin", rf"([{letters}])-{gap}([{LOWER}])", r"\1\2", "g"),
        ("hyphen_keep", rf"([{letters}])-{gap}([{UPPER}])", r"\1-\2", "g"),
        ("emdash_break_join", r"—[ \t]*\r?\n[ \t]*", "—", "g"),
        ("line_break_join", rf"([{LOWER},;:»“”„)\]])[ \t]*\r?\n[ \t]*([{LOWER}])", r"\1 \2", "g"),
        ("spaces_collapsed", r"[ \t]{2,}", " ", "g"),
        ("space_before_punct", r"[ \t]+([,.;:!?])", r"\1", "g"),
    )
    steps = [r"WITH s0 AS (SELECT doc_id, regexp_matches(text, '(?s)^---\s*\n(.*?\n)?---\s*\n') AS front_matter_stripped, regexp_replace(text, '(?s)^---\s*\n(.*?\n)?---\s*\n', '') AS t FROM (SELECT doc_id, " + _WORN_SQL + " AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))"]
    for k, (name, pattern, to, flags) in enumerate(rules):
        found = f"'(?i){pattern}'" if "i" in flags else f"'{pattern}'"
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (t), CAST(len(regexp_extract_all(t, {found})) AS INTEGER) AS {name}, regexp_replace(t, '{pattern}', '{to}', '{flags}') AS t FROM s{k})")
    return ", ".join(steps) + f" SELECT * EXCLUDE (t), md5(t) AS repaired_md5 FROM s{len(rules)}"


@query(_repair_sql())
def repair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_worn(spark, sf_dir)).withColumn("repaired_md5", F.md5("repaired")).drop("text", "repaired")


_PAIR = """p AS (SELECT doc_id, text AS raw, CASE doc_id % 6 WHEN 0 THEN replace(text, ' the ', ' ') WHEN 1 THEN text || ' more' WHEN 2 THEN lower(text) WHEN 3 THEN replace(text, 'a', 'ä') WHEN 4 THEN '' ELSE replace(text, ' ', chr(10)) END AS cleaned FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    made = F.when(k == 0, F.replace(t, F.lit(" the "), F.lit(" "))).when(k == 1, F.concat(t, F.lit(" more"))).when(k == 2, F.lower(t)).when(k == 3, F.replace(t, F.lit("a"), F.lit("ä"))).when(k == 4, "")
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("raw"), made.otherwise(F.replace(t, F.lit(" "), F.lit("\n"))).alias("cleaned"))


@query(f"""WITH {_PAIR}, w AS (SELECT doc_id, cleaned, {_WORDS.format("raw")} AS a, {_WORDS.format("cleaned")} AS b, NOT regexp_matches(cleaned, '[^\\s\\x1c-\\x1f]') AS blank FROM p),
f AS (SELECT *, CASE WHEN len(a) = len(b) THEN list_position(list_transform(list_zip(a, b), lambda x: x[1] <> x[2]), true) END AS pos FROM w)
SELECT doc_id, NOT blank AND len(a) = len(b) AND coalesce(pos, 0) = 0 AS ok, CAST(CASE WHEN blank THEN 0 ELSE abs(len(a) - len(b)) END AS INTEGER) AS words_deleted, CAST(CASE WHEN NOT blank AND pos > 0 THEN pos END AS INTEGER) AS first_difference FROM f""")
def structure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumns({"a": T.words(F.col("raw")), "b": T.words(F.col("cleaned"))})
    return p.select("doc_id", T.structure_verdict(F.col("raw"), F.col("cleaned"), F.col("a"), F.col("b")).alias("v")).select("doc_id", "v.*")


@query(f"""WITH {_PAIR}, w AS (SELECT *, list_sum(list_transform({_WORDS.format("raw")}, lambda x: length(x))) AS a, list_sum(list_transform({_WORDS.format("cleaned")}, lambda x: length(x))) AS b FROM p)
SELECT doc_id, CASE WHEN coalesce(a, 0) = 0 THEN 1.0 ELSE coalesce(b, 0) / a::DOUBLE END AS letters_ratio, regexp_matches(cleaned, '[{T.ACCENTS}]') AND NOT regexp_matches(raw, '[{T.ACCENTS}]') AS accents_introduced FROM w""")
def letters_and_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("raw"), F.col("cleaned")
    return _pairs(spark, sf_dir).select("doc_id", T.letters_ratio(a, b).alias("letters_ratio"), T.accents_introduced(a, b).alias("accents_introduced"))


_NOUNS = rf"""k AS (SELECT doc_id, text, {_WORDS.format("text")} AS w, regexp_split_to_array(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS s FROM t),
o AS (SELECT doc_id, w[i] AS noun, right(coalesce(CASE WHEN i > 1 THEN w[i-1] END, '') || s[i], 2) AS before FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM k)),
nouns AS (SELECT doc_id, noun FROM o WHERE length(noun) >= 4 AND regexp_matches(noun, '^\p{{Lu}}') AND regexp_replace(before, '^\s+|\s+$', '', 'g') NOT IN ('', '.', '!', '?', ':', ';'))"""


@query(f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_NOUNS} SELECT noun, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM nouns GROUP BY noun")
def proper_noun_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nouns = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.proper_nouns(F.coalesce("text", F.lit("")))).alias("noun"))
    per_doc = nouns.groupBy("noun", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("noun").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH {_PAIR}, t AS (SELECT doc_id * 2 AS doc_id, raw AS text FROM p UNION ALL SELECT doc_id * 2 + 1, cleaned FROM p), {_NOUNS},
c AS (SELECT doc_id // 2 AS doc_id, noun, count(*) FILTER (doc_id % 2 = 0) - count(*) FILTER (doc_id % 2 = 1) AS lost FROM nouns GROUP BY ALL)
SELECT doc_id, array_to_string(list(noun ORDER BY noun), ',') AS nouns_dropped FROM c WHERE lost > 0 GROUP BY doc_id""")
def proper_noun_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference of nouns by aggregation: +1 for each in the raw text, -1 for each in the cleaned one."""
    p = _pairs(spark, sf_dir)
    side = lambda c, n: p.select("doc_id", F.explode(T.proper_nouns(F.col(c))).alias("noun"), F.lit(n).alias("n"))
    lost = side("raw", 1).union(side("cleaned", -1)).groupBy("doc_id", "noun").agg(F.sum("n").alias("n")).where("n > 0")
    return lost.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("noun")), ",").alias("nouns_dropped"))


@query()
def cleanup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verdict; words deleted, defined by a sequence matcher's edit script, letters and lost nouns come from one pass in Python."""
    a, b = F.col("raw"), F.col("cleaned")
    p = _pairs(spark, sf_dir).select("*", U.word_changes(a, b).alias("c"), T.accents_introduced(a, b).alias("accents"))
    p = p.select("*", F.col("c.words_deleted").alias("words_deleted"), F.col("c.length_ratio").alias("length_ratio"), F.col("c.nouns_dropped").alias("dropped"))
    empty = T.is_blank(b)
    ok = ~empty & (F.col("words_deleted") <= 2) & (F.col("length_ratio") >= 0.97) & (F.size("dropped") == 0) & ~F.col("accents")
    return p.select("doc_id", ok.alias("ok"), F.when(~empty, F.col("words_deleted")).alias("words_deleted"), F.when(~empty, F.round("length_ratio", 4)).alias("length_ratio"), F.slice("dropped", 1, 20).alias("nouns_dropped"), F.when(ok, b).otherwise(a).alias("kept"))


@query()
def diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", U.diff_ranges("raw", "cleaned").alias("d")).select("doc_id", F.to_json("d.raw").alias("raw_ranges"), F.to_json("d.cleaned").alias("cleaned_ranges"))


_MARKED = ", ".join("'" + m.replace("'", "''") + "'" for m in T.MARKERS if m != "...")


@query(f"""WITH {_D}, w AS (SELECT doc_id, lower(text) AS low FROM d), p AS (SELECT doc_id, m, string_split(low, m) AS parts FROM w JOIN (SELECT unnest([{_MARKED}]) AS m) k ON contains(low, m)),
i AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p), s AS (SELECT doc_id, m, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(m) AS INTEGER) AS start FROM i)
SELECT doc_id, start, CAST(start + length(m) AS INTEGER) AS "end", 'marker' AS tag FROM s""")
def marker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", F.explode(U.marker_ranges("text")).alias("r")).select("doc_id", "r.*")


@query()
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.chunk_rows(_pages(spark, sf_dir)).select("doc_id", "chunk_id", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query()
def reassembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = U.chunk_rows(_pages(spark, sf_dir), dedupe=True)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(U.reassembled("chunk_id", "chunk")).alias("text_md5"))


#: The SQL engine's distance counts bytes, so each letter outside ASCII stands for an unused control character there.
_ONE_BYTE = "translate(text, 'äöüÄÖÜßéèêÉÈÊàâçÇñÑíÍóÓúÚá', " + " || ".join(f"chr({k})" for k in (*range(1, 9), *range(14, 32))) + ")"
_CER = f"c AS (SELECT item_id, {_ONE_BYTE} AS ref, regexp_replace({_ONE_BYTE}, CASE item_id % 3 WHEN 0 THEN 'th' WHEN 1 THEN 'e' ELSE 'on' END, CASE item_id % 3 WHEN 0 THEN 'tli' WHEN 1 THEN '' ELSE 'no' END, 'g') AS hyp FROM benchmark)"


def _read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, k = F.col("text"), F.col("item_id") % 3
    hyp = F.when(k == 0, F.replace(ref, F.lit("th"), F.lit("tli"))).when(k == 1, F.replace(ref, F.lit("e"), F.lit(""))).otherwise(F.replace(ref, F.lit("on"), F.lit("no")))
    return read(spark, sf_dir, "benchmark").select("item_id", ref.alias("ref"), hyp.alias("hyp"))


@query(f"WITH {_CER} SELECT item_id, CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END ELSE least(1.0::DOUBLE, levenshtein(ref, hyp) / length(ref)::DOUBLE) END AS cer FROM c")
def cer_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_pairs(spark, sf_dir).select("item_id", T.character_error_rate(F.col("ref"), F.col("hyp")).alias("cer"))


@query(f"WITH {_CER} SELECT CASE WHEN sum(length(ref)) = 0 THEN 0.0 ELSE sum(least(1.0::DOUBLE, levenshtein(ref, hyp) / length(ref)::DOUBLE) * length(ref)) / sum(length(ref)) END AS weighted_cer, CAST(sum(length(ref)) AS BIGINT) AS n_chars FROM c")
def weighted_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read_pairs(spark, sf_dir).select(T.character_error_rate(F.col("ref"), F.col("hyp")).alias("cer"), F.length("ref").alias("n"))
    return p.agg(F.coalesce(F.sum(F.col("cer") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("weighted_cer"), F.sum("n").alias("n_chars"))


_TITLE = "coalesce(string_split(text, chr(10))[1], '')"


def _title() -> F.Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")[0]


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Der der Brief der' ELSE {_TITLE} END AS t FROM documents), w AS (SELECT doc_id, list_transform({_WORDS.format("t")}, lambda x: lower(x)) AS w FROM t)
SELECT doc_id, CASE WHEN len(w) < 3 THEN false ELSE list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) / len(w)::DOUBLE >= 0.5 END AS repeats FROM w""")
def title_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 4 == 0, "Der der Brief der").otherwise(_title())
    return read(spark, sf_dir, "documents").select("doc_id", T.title_repeats(title).alias("repeats"))


_SAFE = r"(CASE WHEN {0} = '' THEN '{1}' ELSE {0} END)"
_SAFE_OF = r"left(trim(regexp_replace(regexp_replace(translate({}, '<>:\"/\|?*', '_________'), '^[ .]+|[ .]+$', '', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')), 120)".replace('\\"', '"')
_NAMED = f"""n AS (SELECT doc_id, source, {_TITLE} || CASE doc_id % 4 WHEN 0 THEN ' a/b:c?' WHEN 1 THEN ' ..' WHEN 2 THEN '' ELSE '  x  *' END AS name FROM documents),
s AS (SELECT *, {_SAFE_OF.format("name")} AS safe FROM n)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.concat(_title(), F.when(k == 0, " a/b:c?").when(k == 1, " ..").when(k == 2, "").otherwise("  x  *"))
    return read(spark, sf_dir, "documents").select("doc_id", "source", name.alias("name"))


@query(f"WITH {_NAMED} SELECT doc_id, {_SAFE.format('safe', 'untitled')} AS safe FROM s")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", T.safe_name(F.col("name")).alias("safe"))


@query(f"""WITH {_NAMED} SELECT doc_id, {_SAFE.format('safe', 'untitled')} || '/scan' || (doc_id % 50) || CASE WHEN doc_id % 3 = 0 THEN '_p' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 4, '0') ELSE '' END AS stem FROM s""")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = F.col("doc_id") % 3 == 0
    file = F.concat(F.lit("dir/scan"), F.col("doc_id") % 50, F.when(pdf, ".pdf").otherwise(".jpg"))
    return _named(spark, sf_dir).select("doc_id", T.page_stem(F.col("name"), file, F.when(pdf, F.col("doc_id") % 12), F.lit("image/jpeg")).alias("stem"))


@query(rf"""WITH {_NAMED} SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^\p{{L}}\p{{N}}\p{{M}}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", T.slug(F.col("name")).alias("slug"))


@query("""WITH c AS (SELECT conv_id, turn, replace(replace(coalesce(text, ''), ', ', ' <&> "x" '), '. ', '.' || chr(13) || chr(10) || chr(10)) AS t FROM conversations),
e AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM c)
SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN x = '' THEN '<p><br></p>' ELSE '<p>' || x || '</p>' END), '')) AS html_md5 FROM e""")
def note_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(' <&> "x" ')), F.lit(". "), F.lit(".\r\n\n"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.note_html(t)).alias("html_md5"))


_FLAT = r"regexp_replace(coalesce(text, ' '), '[\s\x1c-\x1f]+', ' ', 'g')"


@query(f"SELECT conv_id, turn, md5({_STRIP.format(_FLAT)}) AS text_md5 FROM conversations")
def note_text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.note_text(F.coalesce("text", F.lit(" ")))).alias("text_md5"))


@query("SELECT doc_id, CAST(trunc(length(text) / 3.5::DOUBLE) AS INTEGER) AS tokens, trunc(length(text) / 3.5::DOUBLE) <= 3500 AS fits FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.token_estimate(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), (n <= 3500).alias("fits"))


_SAID = "CASE doc_id % 5 WHEN 0 THEN upper(lang) || ', en' WHEN 1 THEN 'german' WHEN 2 THEN ' ' || lang || ' ' WHEN 3 THEN 'd3' ELSE 'it' END"


@query(f"""WITH s AS (SELECT doc_id, trim(string_split(lower(trim({_SAID})), ',')[1]) AS c FROM documents), k AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^\\p{{L}}{{1,3}}$') THEN c ELSE 'unknown' END AS code FROM s)
SELECT code, coalesce(map {{{", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items())}}}[code], code) AS name, count(*) AS n FROM k GROUP BY ALL""")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.upper("lang"), F.lit(", en"))).when(k == 1, "german").when(k == 2, F.concat(F.lit(" "), "lang", F.lit(" "))).when(k == 3, "d3").otherwise("it")
    d = read(spark, sf_dir, "documents").select(T.language_code(said).alias("code"))
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", T.language_name(F.col("code")).alias("name"), "n")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{"a":' || page_id || '}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN NULL ELSE '"x"' END AS body FROM pages""")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    said = F.when(k == 0, F.concat(F.lit('```json\n{"a":'), "page_id", F.lit("}\n```"))).when(k == 1, "  [1, 2] ").when(k == 2, "no json {").otherwise('```\n"x"```')
    return read(spark, sf_dir, "pages").select("page_id", T.fenced_json(said).alias("body"))


@query("SELECT page_id, CAST(CASE page_id % 5 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 8 END AS INTEGER) AS code FROM pages")
def rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("page_id") % 5).cast("int")
    said = F.concat(F.lit("Page number: 0\nRotate: "), F.element_at(F.array(*[F.lit(x) for x in ("0", "90", "180", "270", "x")]), k + 1), F.lit("\nScript: Latin"))
    return read(spark, sf_dir, "pages").select("page_id", T.rotation_code(said).alias("code"))
