"""Model calls as pluggable effects, and the deterministic stages around them.

A ModelFn maps a list of texts to a list of answers; it runs in Arrow batches, one client a partition. Rows that
need no call are split off before it, as Spark would run a Python function inside when() for every row. A failed
call is an error column on its row, never a failed job. What a model has said is written before anything reads it, so
no call is made twice; rows are told apart by a number of their own, so ids may be null or repeat.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.functions.repair import repair
from pagelake.functions.udf import chunk_rows, reassembled, word_changes
from pagelake.store import small, stash

ModelFn = Callable[[list[str]], list[str]]
TemperedFn = Callable[[list[str], float], list[str]]
#: Number of a row, in tables that are written once and read by it.
ROW = "_row"


def ladder(start: float = 0.1, step: float = 0.1, most: float = 0.8, rungs: int = 50) -> list[float]:
    """Rising temperatures; a step that isn't above 0.01 counts as 0.01, and there are 50 rungs at most, none if the start is above the end."""
    step, out, t = step if step > 0.01 else 0.01, [], start
    while t <= most + 1e-9 and len(out) < (rungs if start <= most else 0):
        out.append(round(t, 4))
        t += step
    return out


def retried(model: ModelFn, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> ModelFn:
    """Connection errors and timeouts are tried again, after doubling waits."""

    def run(texts: list[str]) -> list[str]:
        for k in range(attempts):
            try:
                return model(texts)
            except (ConnectionError, TimeoutError):
                if k + 1 == attempts:
                    raise
                sleep(min(base * 2**k, most))
        raise AssertionError

    return run


def call(df: DataFrame, model: ModelFn, text: str = "text", out: str = "answer", keys: tuple[str, ...] = ("doc_id",), batch: int = 16) -> DataFrame:
    """keys, `out` and error for each row; a batch that fails is tried row by row, so one bad row fails alone."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def answer(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = model(texts)
            if len(said) != len(texts):
                raise ValueError("number of answers")
            return [(s, None) for s in said]
        except Exception as e:
            return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [a for t in texts for a in answer([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [a for k in range(0, len(b), batch) for a in answer([t or "" for t in b[text].iloc[k : k + batch]])]
            yield b[list(keys)].assign(**{out: [g[0] for g in got], "error": [g[1] for g in got]})

    return df.select(*dict.fromkeys([*keys, text])).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{out}` string, error string")


def numbered(df: DataFrame) -> DataFrame:
    """df, written once, with a number for each row; as it is if it has one."""
    return df if ROW in df.columns else stash(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def asked(df: DataFrame, model: ModelFn, text: str, out: str = "answer", keys: tuple[str, ...] = (ROW,)) -> DataFrame:
    """What call gives, written: each row is sent to the model once, however often its answer is read."""
    return stash(call(df, model, text, out, keys), "answers")


def judged(said: DataFrame, guard: bool = True) -> DataFrame:
    """Answers with the reason why they can't be used: a failed call, or a loop."""
    t = F.coalesce("answer", F.lit(""))
    loop = T.repetition_reason(t, T.ngram_tokens(t), T.lines(t)) if guard else F.lit(None).cast("string")
    return said.withColumn("reason", F.coalesce(F.when(F.col("error").isNotNull(), "error"), loop))


def read_pages(pages: DataFrame, vision: ModelFn | TemperedFn, fallback: ModelFn | None = None, text: str = "image", blank: str = "blank", temperatures: list[float] | None = None, guard: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, error, engine, temperature, attempts), rejected (doc_id, rejected_text, reason, error, attempts): every page is in one of them, once.

    Blank pages give '' without a call; a null `blank` is no blank page. With temperatures, vision takes one and a page whose
    answer loops goes on to the next; a failed call ends its climb. Pages that are left go to the second engine, whose answer
    counts unless it is blank, fails or loops. Ids may be null or repeat. Each round works on the pages still open and writes
    its answers first: the model sees a page once at each temperature.
    """
    rows = numbered(pages.select("doc_id", F.col(text).alias("_image"), F.coalesce(F.col(blank), F.lit(False)).alias("_blank")))
    open_ = rows.where(~F.col("_blank"))
    columns = [ROW, "answer", "error", "reason", "temperature", "attempts"]
    rounds: list[tuple[float | None, ModelFn]] = [(None, vision)] if temperatures is None else [(t, lambda texts, t=t: vision(texts, t)) for t in temperatures]
    accepted, failed = [], []
    for k, (t, model) in enumerate(rounds, 1):
        said = stash(judged(call(open_, model, "_image", keys=(ROW,)), guard), "answers").withColumns({"temperature": F.lit(t).cast("double"), "attempts": F.lit(k)})
        accepted.append(said.where("reason is null").select(columns))
        failed.append(said.where("error is not null").select(columns))
        loops = said.where("reason is not null and error is null").select(columns)
        if k == len(rounds):
            failed.append(loops)
        elif loops.isEmpty():
            break
        open_ = rows.join(small(loops.select(ROW)), ROW, "left_semi")
    if not rounds:
        failed.append(open_.select(ROW, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit("no temperature").alias("reason"), F.lit(None).cast("double").alias("temperature"), F.lit(0).alias("attempts")))
    bad = reduce(DataFrame.unionByName, failed).withColumn("engine", F.lit("vision"))
    good = reduce(DataFrame.unionByName, accepted).withColumn("engine", F.lit("vision")) if accepted else bad.limit(0)
    if fallback is not None:
        bad = stash(bad, "answers")
        again = judged(asked(rows.join(small(bad.select(ROW)), ROW, "left_semi"), fallback, "_image"), guard)
        there = F.trim(F.coalesce("answer", F.lit(""))) != ""
        again = again.select(ROW, *[F.col(c).alias(f"_{c}") for c in ("answer", "error", "reason")], (F.col("reason").isNull() & there).alias("_usable"), there.alias("_there"))
        both = bad.join(again, ROW)
        good = good.unionByName(both.where("_usable").select(ROW, F.col("_answer").alias("answer"), F.col("_error").alias("error"), F.col("_reason").alias("reason"), "temperature", "attempts", F.lit("fallback").alias("engine")))
        # a loop of the second engine is what is told, unless the first one's loop was found without a ladder
        looped = F.col("_reason").isNotNull() & F.col("_there") & (F.lit(temperatures is not None) | F.col("error").isNotNull())
        told = {c: F.when(looped, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("answer", "error", "reason")}
        bad = both.where(~F.col("_usable")).withColumns(told).select(*columns, "engine")
    ids = rows.select(ROW, "doc_id", "_blank")
    good = ids.join(good, ROW).select("doc_id", F.coalesce("answer", F.lit("")).alias("text"), "error", "engine", "temperature", "attempts")
    empty = ids.where("_blank").select("doc_id", F.lit("").alias("text"), F.lit(None).cast("string").alias("error"), F.lit("blank").alias("engine"), F.lit(None).cast("double").alias("temperature"), F.lit(0).alias("attempts"))
    return good.unionByName(empty), ids.join(bad, ROW).select("doc_id", F.col("answer").alias("rejected_text"), "reason", "error", "attempts")


def by_chunks(df: DataFrame, model: ModelFn, text: str, max_tokens: int = 3500, overlap: int = 200) -> DataFrame:
    """df, its rows numbered, with answer and error: chunk, call, put together in order."""
    rows = numbered(df)
    said = asked(chunk_rows(rows.select(ROW, F.coalesce(F.col(text), F.lit("")).alias(text)), text, max_tokens, overlap, keys=(ROW,)), model, "chunk", "said", (ROW, "chunk_id"))
    said = said.groupBy(ROW).agg(reassembled("chunk_id", "said").alias("answer"), F.first("error", ignorenulls=True).alias("error"))
    return rows.join(said, ROW)


def clean(pages: DataFrame, model: ModelFn, guard: bool = True) -> DataFrame:
    """doc_id, cleaned, ok, error: repairs, then the model, then the guard; what it rejects keeps the repaired text.

    Without the guard every answer counts, unless the call failed.
    """
    r = numbered(repair(pages.select("doc_id", "text")).select("doc_id", F.col("repaired").alias("text")))
    j = by_chunks(r, model, "text").withColumn("answer", F.coalesce("answer", F.lit("")))
    a, b = F.col("text"), F.col("answer")
    ok = F.col("error").isNull()
    if guard:
        j = j.withColumn("change", word_changes(a, b))
        ok = ok & ~T.is_blank(b) & (F.col("change.words_deleted") <= 2) & (T.letters_ratio(a, b) >= 0.97) & (F.size("change.nouns_dropped") == 0) & ~T.accents_introduced(a, b)
    return j.select("doc_id", F.when(ok, b).otherwise(a).alias("cleaned"), ok.alias("ok"), "error")


def structure(pages: DataFrame, model: ModelFn, done: DataFrame | None = None) -> DataFrame:
    """doc_id, structured, ok: paragraphs only; if a word changes, the text stays as it was.

    Pages whose doc_id is in `done` (doc_id, structured, ok: an earlier result) keep that and aren't sent again; a null id is never done.
    """
    rows = numbered(pages.select("doc_id", "text"))
    kept = None
    if done is not None:
        before = done.where("doc_id is not null").groupBy("doc_id").agg(F.first("structured").alias("structured"), F.first("ok").alias("ok"))
        kept = rows.join(before, "doc_id").select("doc_id", "structured", "ok")
        rows = rows.join(before, "doc_id", "left_anti")
    j = by_chunks(rows, model, "text", overlap=0).withColumn("answer", F.coalesce("answer", F.lit("")))
    v = T.structure_verdict(F.col("text"), F.col("answer"), T.words(F.col("text")), T.words(F.col("answer")))
    out = j.select("doc_id", F.when(v["ok"], F.col("answer")).otherwise(F.col("text")).alias("structured"), v["ok"].alias("ok"))
    return out if kept is None else out.unionByName(kept)


def translate(pages: DataFrame, detect: ModelFn, model: ModelFn, assess: ModelFn | None = None, head: int | None = 2000, max_tokens: int = 3500) -> DataFrame:
    """doc_id, source_language, translated, skipped, score: English texts are split off before any call.

    head: how many characters the language is told by, None for all; texts above max_tokens are translated in chunks.

    score: 60 : 40 of the markers in both texts and the score that assess gives them (a number from 0 to 100 first thing in
    its answer; a failed call: 50), without assess of the markers alone. Each row is detected, translated and assessed once.
    """
    rows = numbered(pages.select("doc_id", "text"))
    seen = F.col("text") if head is None else F.left("text", F.lit(head))
    said = asked(rows.select(ROW, F.coalesce(seen, F.lit("")).alias("head")), detect, "head", "code")
    p = rows.join(said.select(ROW, T.language_code(F.coalesce("code", F.lit(""))).alias("source_language")), ROW)
    done = by_chunks(p.where("source_language <> 'en'"), model, "text", max_tokens).withColumn("both", F.concat_ws(" ", "text", "answer"))
    score = T.heuristic_score(T.marker_count(F.col("both")), T.word_count(F.col("both")))
    own = score
    if assess is not None:
        said = asked(done.select(ROW, "both"), assess, "both", "rated")
        rated = F.when(F.col("error").isNull(), F.nullif(F.regexp_extract("rated", r"^\D*(\d{1,3})", 1), F.lit("")).cast("int"))
        done = done.join(said.select(ROW, F.when(rated.isNotNull(), F.least(rated, F.lit(100))).alias("_rated")), ROW)
        own = F.col("_rated")
    score = T.overall_score(score, own)
    out = done.select("doc_id", "source_language", F.col("answer").alias("translated"), F.lit(False).alias("skipped"), score.alias("score"))
    same = p.where("source_language = 'en'").select("doc_id", "source_language", F.col("text").alias("translated"), F.lit(True).alias("skipped"), F.lit(None).cast("int").alias("score"))
    return out.unionByName(same)


def titles(pages: DataFrame, model: ModelFn, most: int = 120) -> DataFrame:
    """doc_id, title, generated, language, truncated, accent_warning, error: an answer that fails, is no JSON with a title, or loops gives the page's stem, and why.

    The model sees 2,000 characters. A title of more than `most` characters is cut; one with accents where the page's 2,000
    characters have none is kept with a warning.
    """
    rows = numbered(pages.select("doc_id", "stem", F.left("text", F.lit(2000)).alias("text")))
    json = T.fenced_json(F.col("said"))
    said = asked(rows, model, "text", "said").select(ROW, F.trim(F.get_json_object(json, "$.title")).alias("said_title"), F.get_json_object(json, "$.language").alias("said_language"), F.col("error").alias("call_error"))
    whole = F.coalesce("said_title", F.lit(""))
    j = rows.join(said, ROW).withColumn("t", F.left(whole, F.lit(most)))
    why = F.coalesce("call_error", F.when(F.col("t") == "", "no JSON with a title"), F.when(T.title_repeats(F.col("t")), F.concat(F.lit("repetition loop: "), "t")))
    good, source = why.isNull(), F.coalesce("text", F.lit(""))
    return j.select(
        "doc_id", F.when(good, F.col("t")).otherwise(F.col("stem")).alias("title"), good.alias("generated"), F.when(good, F.coalesce("said_language", F.lit(""))).otherwise("").alias("language"),
        (good & (F.length(whole) > most)).alias("truncated"), (good & (source != "") & T.accents_introduced(source, F.col("t"))).alias("accent_warning"), why.alias("error"),
    )


def resolve_model(installed: DataFrame, recommended: DataFrame, chosen: str | None = None) -> DataFrame:
    """role, model, how of each role in recommended: a model that is installed, under the name it has there, or null.

    The user's choice, if it is installed (user), else none (configured_missing); without a choice the first recommendation that
    is installed (recommended), else the first installed model that may fit (fallback), else none. An embedding role takes names
    with `embed` alone, vision is never guessed, other roles take any other name. installed: name, and ord where the order isn't
    that of names. recommended: role, name, ord, and vision where only some can see: a vision role takes no others. The same
    name counts first, else one that differs in ':' and '-' only; of several such the first installed.
    """
    same = lambda c: F.replace(c, F.lit(":"), F.lit("-"))
    ord_ = F.col("ord") if "ord" in installed.columns else F.col("name")
    have = installed.where("name is not null").groupBy(F.col("name").alias("_name")).agg(F.min(ord_).alias("_ord")).withColumn("_same", same(F.col("_name")))
    wanted = recommended if "vision" in recommended.columns else recommended.withColumn("vision", F.lit(True))
    roles = recommended.select("role").distinct()
    if chosen:
        wanted, how = roles.select("role", F.lit(chosen).alias("name"), F.lit(0).alias("ord")), "user"
    else:
        wanted, how = wanted.where("role <> 'vision' or vision").select("role", "name", "ord"), "recommended"
    found = wanted.join(have, same(F.col("name")) == F.col("_same"))
    best = found.groupBy("role").agg(F.min_by("_name", F.struct("ord", F.col("_name") != F.col("name"), "_ord")).alias("_best"))
    out = roles.join(best, "role", "left")
    if chosen:
        return out.select("role", F.col("_best").alias("model"), F.when(F.col("_best").isNotNull(), how).otherwise("configured_missing").alias("how"))
    embeds = F.contains(F.lower("_name"), F.lit("embed"))
    spare = have.agg(F.min_by(F.when(embeds, F.col("_name")), F.when(embeds, F.col("_ord"))).alias("_embeds"), F.min_by(F.when(~embeds, F.col("_name")), F.when(~embeds, F.col("_ord"))).alias("_others"))
    j = out.join(F.broadcast(spare))  # one row
    guess = F.when(F.col("role") == "embedding", F.col("_embeds")).when(F.col("role") != "vision", F.col("_others"))
    return j.select("role", F.coalesce("_best", guess).alias("model"), F.when(F.col("_best").isNotNull(), how).when(guess.isNotNull(), "fallback").otherwise("none").alias("how"))
