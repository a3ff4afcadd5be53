"""URL filtering by fixed rules and, where none fits, by mined association rules.

A fixed rule names a host, which stands for its subdomains too, and the beginning of a
path; of the rules that fit an url the longest decides.  The urls that fixed rules
decide are the labels.  Spark's FP-growth mines combinations of url tokens that go
with a verdict; rules below ``min_support`` or ``min_confidence`` are pruned, and so is
a rule whose shorter form is as sure.  Tokens that occur in the very same labelled urls
are one item to the miner, found in an url that has any of them: that is what the rules
of single tokens would find, and an url of many segments that is repeated does not
make a rule of every subset.  All other rules are kept, unless ``max_rules`` asks for
the surest only.  They match by an inverted index: each rule stands under the rarest token of its combination, so
an url looks up its own tokens only.  Up to ``BROADCAST_RULES`` the index is sent to the
executors; more rules stay a table, which the urls' tokens are joined with.  The surest rule that fits decides, then the
longer, the more frequent, and the first by name; no fit gives ``default``.

Known limit: the miner lists all frequent combinations, whose number grows with the
tokens that are frequent together in differing sets of urls; ``min_support`` bounds it.

Defined cases: an url that is null or lacks ``://`` has empty host and path, no
tokens and the default verdict; without labelled urls there are no mined rules; equal
rows are judged alike and count once each as labels; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwright.sources.shared_tables import discard, stash

#: (verdict, host, beginning of the path)
Rule = tuple[str, str, str]
_VERDICT = "=verdict:"
#: Mined rules that are sent to the executors at most; more are joined as a table.
BROADCAST_RULES = 20_000


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(url)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        name, verdict = F.when(fits, at + begin).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys; digits are ``#``."""
    plain = F.regexp_replace(F.lower(path), "[0-9]+", "#")
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    parts = F.array_distinct(
        F.concat(
            named("host:", F.split(host, r"\.")),
            named("path:", F.split(plain, "/")),
            named("key:", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
            F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
        )
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(parts)


def token_classes(labelled: DataFrame, min_support: float) -> dict[str, str]:
    """For each token of at least ``min_support`` of the rows the first by name of those that occur in the same rows.

    A row has few tokens, so no more than its tokens / ``min_support`` are so frequent.
    Sets of rows are told apart by their size and two 64-bit sums of row hashes.
    """
    rows = labelled.select("tokens", F.monotonically_increasing_id().alias("row"))
    least = F.lit(min_support) * F.lit(rows.count())
    seen = rows.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("a"), F.xxhash64(F.lit(1), "row").alias("b"))
    tokens = seen.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    names = tokens.groupBy("n", "a", "b").agg(F.min("token").alias("name"))
    return {r["token"]: r["name"] for r in tokens.join(names, ["n", "a", "b"]).select("token", "name").collect()}


def mined_table(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame | None:
    """Rules from ``(tokens, verdict)`` rows as a written table of antecedent, verdict, confidence and support; none without rows."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(_VERDICT))
    found = found.select(F.sort_array("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), len(_VERDICT) + 1, 100).alias("verdict"), "confidence", "support")
    found = stash(found.withColumn("id", F.monotonically_increasing_id()), "rules")
    kept = stash(_irredundant(found).drop("id"), "kept-rules")
    discard(found)
    return kept


def mine(labelled: DataFrame, min_support: float, min_confidence: float, max_rules: int | None = None) -> list[dict]:
    """The rules of ``mined_table``, surest first, where they are known to be few."""
    found = mined_table(labelled, min_support, min_confidence)
    return _listed(found, max_rules)


def _listed(found: DataFrame | None, max_rules: int | None) -> list[dict]:
    rows = [r.asDict() for r in found.collect()] if found is not None else []
    for r in rows:
        r["tokens"] = frozenset(r["antecedent"])
    return sorted(rows, key=_sureness)[:max_rules]


def _irredundant(rules: DataFrame) -> DataFrame:
    """Rules of which no shorter form with the same verdict is as sure; a rule meets shorter ones by their rarest token."""
    tokens = rules.select("id", F.size("antecedent").alias("n"), "antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    short = rules.join(_rarest(tokens), "id").select("token", "verdict", F.size("antecedent").alias("m"), F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    met = tokens.join(short, ["token", "verdict"]).where((F.col("m") < F.col("n")) & (F.col("sure") >= F.col("confidence")))
    return rules.join(met.where(F.size(F.array_except("part", "antecedent")) == 0).select("id").distinct(), "id", "left_anti")


def _rarest(tokens: DataFrame) -> DataFrame:
    """``(id, token)``: of the tokens of each rule the one that the fewest rules have."""
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    return tokens.join(often, "token").groupBy("id").agg(F.min(F.struct("often", "token"))["token"].alias("token"))


def join_rules(rows: DataFrame, rules: DataFrame, max_rules: int | None = None) -> DataFrame:
    """``rows`` with ``best``, the surest rule whose tokens are all among ``items``, by the rule's rarest token; both are written tables.

    ``rows`` has ``number``, its own for each row.
    """
    order = F.struct((-F.col("confidence")).alias("c"), (-F.size("antecedent")).alias("n"), (-F.col("support")).alias("s"), "antecedent", "verdict")
    if max_rules is not None:
        rules = rules.orderBy(order).limit(max_rules)
    numbered = stash(rules.select(order.alias("best")).withColumn("id", F.monotonically_increasing_id()), "numbered")
    rarest = _rarest(numbered.select("id", F.explode("best.antecedent").alias("token")))
    indexed = stash(numbered.join(rarest, "id").select("token", "best"), "indexed")
    met = rows.select("number", "items", F.explode("items").alias("token")).join(indexed, "token")
    met = met.where(F.size(F.array_except("best.antecedent", "items")) == 0)
    return rows.join(met.groupBy("number").agg(F.min("best").alias("best")), "number", "left")


def _sureness(r: dict) -> tuple:
    return -r["confidence"], -len(r["antecedent"]), -r["support"], r["antecedent"], r["verdict"]


def inverted_index(rules: list[dict]) -> dict[str, list[tuple[int, frozenset]]]:
    """Under the token of each rule that the fewest rules have: the rule's rank and its tokens."""
    often: dict[str, int] = defaultdict(int)
    for r in rules:
        for token in r["antecedent"]:
            often[token] += 1
    index = defaultdict(list)
    for rank, r in enumerate(rules):
        index[min(r["antecedent"], key=lambda t: (often[t], t))].append((rank, frozenset(r["antecedent"])))
    return dict(index)


def best_rule(tokens: list[str], index: dict[str, list[tuple[int, frozenset]]]) -> int | None:
    have = set(tokens)
    return min((rank for t in have for rank, need in index.get(t, ()) if need <= have), default=None)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.8, max_rules: int | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule and its confidence where one decided."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = stash(rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    labelled = rows.where("rule IS NOT NULL").select("tokens", "verdict")
    names = token_classes(labelled, min_support)
    named = pages.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("array<string>")
    def as_items(tokens: pd.Series) -> pd.Series:
        return pd.Series([sorted({named.value[x] for x in t if x in named.value}) for t in tokens])

    free = F.col("rule").isNull()
    table = mined_table(stash(labelled.select(as_items("tokens").alias("tokens"), "verdict"), "baskets"), min_support, min_confidence)
    if table is not None and table.count() > BROADCAST_RULES:
        asked = stash(rows.select("*", F.when(free, as_items("tokens")).alias("items"), F.monotonically_increasing_id().alias("number")), "asked")
        met = join_rules(asked, table, max_rules)
        return met.select("page_id", "host", "path", "rule", F.coalesce("verdict", "best.verdict", F.lit(default)).alias("verdict"), F.array_join("best.antecedent", " & ").alias("because"), (-F.col("best.c")).alias("confidence"))
    mined = _listed(table, max_rules)
    shared = pages.sparkSession.sparkContext.broadcast((names, inverted_index(mined), [(r["verdict"], " & ".join(r["antecedent"]), r["confidence"]) for r in mined]))

    @F.pandas_udf("verdict string, because string, confidence double")
    def judge(tokens: pd.Series) -> pd.DataFrame:
        known, index, outcomes = shared.value
        found = [best_rule([known[x] for x in t if x in known], index) if t is not None else None for t in tokens]
        return pd.DataFrame([outcomes[k] if k is not None else (default, None, None) for k in found], columns=["verdict", "because", "confidence"])

    judged = rows.withColumn("mined", judge(F.when(free, F.col("tokens"))))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined.verdict").alias("verdict"), F.when(free, F.col("mined.because")).alias("because"), F.when(free, F.col("mined.confidence")).alias("confidence"))
