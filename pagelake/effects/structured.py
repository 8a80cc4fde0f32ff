"""Answers in JSON by the strongest way a provider has, and pages read region by region."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.effects.stages import ModelFn, call

#: How a provider can be made to answer in JSON, strongest first.
MODES = ("native_schema", "json_object", "prompted")
RESULT = "data string, mode_used string, repaired boolean, error string"
#: Answers to texts in one of the MODES.
ModeFn = Callable[[str, list[str]], list[str]]


class UnsupportedMode(ValueError):
    """No way of answering in JSON that is as strong as asked for."""


def rungs(supported: Iterable[str], minimum: str = "prompted") -> list[str]:
    """The provider's ways, strongest first; an error if its best is weaker than the minimum, or it has none."""
    have = [m for m in MODES if m in set(supported)]
    if not have or MODES.index(have[0]) > MODES.index(minimum):
        raise UnsupportedMode(f"at best {have[0] if have else 'no JSON'}, asked for {minimum}")
    return have


def parsed(text: str | None) -> object:
    """The JSON of an answer, fenced or not; None if it is none."""
    inner = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", text or "", re.DOTALL)
    try:
        return json.loads(inner[1] if inner else text or "")
    except ValueError:
        return None


def stepwise(provider: ModeFn, supported: Iterable[str], valid: Callable[[object], bool], minimum: str = "prompted") -> ModelFn:
    """A ModelFn whose answers are RESULTs in JSON: what a rung leaves without valid JSON goes to the next weaker one together."""
    ways = rungs(supported, minimum)

    def run(texts: list[str]) -> list[str]:
        left, out = list(range(len(texts))), [json.dumps({"repaired": len(ways) > 1, "error": f"exhausted at {ways[-1]}"})] * len(texts)
        for k, mode in enumerate(ways):
            found = {i: v for i, a in zip(left, provider(mode, [texts[i] for i in left]), strict=True) if (v := parsed(a)) is not None and valid(v)}
            for i, v in found.items():
                out[i] = json.dumps({"data": json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), "mode_used": mode, "repaired": k > 0})
            left = [i for i in left if i not in found]
            if not left:
                break
        return out

    return run


def structured(df: DataFrame, provider: ModeFn, supported: Iterable[str], valid: Callable[[object], bool], text: str = "text", keys: tuple[str, ...] = ("doc_id",), minimum: str = "prompted") -> DataFrame:
    """keys, data (JSON), mode_used, repaired, error: a row that no rung answers validly has an error, as has one whose call fails."""
    said = call(df, stepwise(provider, supported, valid, minimum), text, "said", keys)
    r = said.withColumn("r", F.from_json("said", RESULT))
    return r.select(*keys, "r.data", "r.mode_used", F.coalesce("r.repaired", F.lit(False)).alias("repaired"), F.coalesce("r.error", "error").alias("error"))


def read_regions(regions: DataFrame, vision: ModelFn, crop: str = "crop") -> DataFrame:
    """page, text, region_count, region_error_count, errors of regions (page, region, place, crop, error), one call a region.

    Regions whose detection failed (error) aren't read; one whose reading fails is counted and listed, and the page's other
    regions keep their texts. Texts come in order of place, blank ones left out.
    """
    failed = F.col("error").isNotNull()
    read = call(regions.where(~failed), vision, crop, "text", ("page", "region", "place"))
    lost = regions.where(failed).select("page", "region", "place", F.lit(None).cast("string").alias("text"), "error")
    listed = F.array_sort(F.collect_list(F.struct("place", "region", "text", "error")))
    g = read.unionByName(lost).groupBy("page").agg(listed.alias("r"))
    bad = F.filter("r", lambda x: x["error"].isNotNull())
    texts = F.filter(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t != "")
    return g.select("page", F.array_join(texts, "\n\n").alias("text"), F.size("r").alias("region_count"), F.size(bad).alias("region_error_count"), F.transform(bad, lambda x: F.struct(x["region"].alias("region"), x["error"].alias("error"))).alias("errors"))
