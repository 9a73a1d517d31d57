"""URL filters by a sort-merge range join.

A rule of a host and a path, and a url, get canonical keys: the host's labels in reverse, a dot after each, then the
path. A rule's subdomains and longer paths are then one interval of keys, from the rule's own key to the last key that
begins with it, and intervals are nested or apart. Rules and urls are sorted together and swept: the beginning of an
interval puts its rule on the stack, its end takes it off, and a url's rule is the top of the stack where the url stands.

Sorted rows are cut into blocks; what a block hands to the next is the top of its stack. A rule knows the rule below it
(its parent, the last that began one level higher), so the top says the whole stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import ROWS_A_BLOCK, before, carried, ordered_blocks
from .common import hot_keys, joined, only, table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules that the query applies, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty for null and where there is no `://`."""
    parts = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(parts(1), CAPITALS, SMALL), parts(2)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Sorted by bytes. A host's key ends in a dot and holds no slash, so that host and path can't be confused."""
    return F.concat(F.array_join(labels, "."), F.lit("."), path).cast("binary")


def rules_of(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A table of rules: host, path, verdict."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict LIMIT 0")
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rules)} AS rules(host, path, verdict)")


def _known(rules: DataFrame) -> DataFrame:
    """A row for each rule: host, path, verdict, key. Of two verdicts of one rule `block` holds."""
    named = only(rules, "host", "path", "verdict").select(F.translate("host", CAPITALS, SMALL).alias("host"), "path", "verdict")
    if named.filter("host is null or path is null or verdict is null or contains(host, '/') or not (path = '' or startswith(path, '/'))").head(1):
        raise ValueError("a rule needs a host without a slash, a path that is empty or begins with one, and a verdict")
    return named.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", _key(_labels(F.col("host")), F.col("path")))


def stack_changes(rules: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """key and top (host, path, verdict): where in the order the top of the stack changes, and what it is from there on.

    At a rule's own key that is the rule; at its interval's end the rule below it, or one without a host if there is none.
    """
    last = F.concat("key", F.lit(b"\xff"))  # no text has this byte, so all that begins with the rule sorts before
    rule = F.struct("host", "path", "verdict")
    edges = rules.select(F.col("key").alias("own"), rule.alias("rule"), F.inline(F.array(F.struct(F.col("key").alias("key"), F.lit(1).alias("step")), F.struct(last.alias("key"), F.lit(-1).alias("step")))))
    placed = ordered_blocks(edges, ["key"], rows_a_block)
    # how many intervals are open after each edge: a running sum in blocks
    totals = placed.groupBy("_block").agg(F.sum("step").alias("_open"))
    offsets = totals.select("_block", F.coalesce(F.sum("_open").over(before()), F.lit(0)).alias("_before"))
    inner = W.partitionBy("_block").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    begun = placed.withColumn("_inner", F.sum("step").over(inner)).join(offsets, "_block").filter("step = 1").select("_block", "own", "rule", (F.col("_before") + F.col("_inner")).alias("level"))
    # a rule's parent is the last rule that began one level higher: rules tell at their level, and ask at the one above
    both = begun.select("_block", "own", "rule", F.inline(F.array(F.struct(F.col("level").alias("level"), F.lit(True).alias("tells")), F.struct((F.col("level") - 1).alias("level"), F.lit(False).alias("tells")))))
    told = F.when(F.col("tells"), F.col("rule"))
    at_level = W.partitionBy("_block", "level").orderBy("own").rowsBetween(W.unboundedPreceding, 0)
    ends = both.groupBy("_block", "level").agg(F.max_by(told, F.when(F.col("tells"), F.col("own"))).alias("_end"))
    handed = ends.select("_block", "level", F.last("_end", ignorenulls=True).over(W.partitionBy("level").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_handed"))
    asked = both.withColumn("_within", F.last(told, ignorenulls=True).over(at_level)).filter("not tells").join(handed, ["_block", "level"])
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")])
    parents = asked.select(F.col("own").alias("key"), "rule", F.coalesce("_within", "_handed", none).alias("parent"))
    return parents.select(F.inline(F.array(F.struct(F.col("key").alias("key"), F.col("rule").alias("top")), F.struct(last.alias("key"), F.col("parent").alias("top")))))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """A row per input row: id, host, path, rule, verdict.

    A rule fits its host and all hosts below it, where the path begins with the rule's; the rule with the most characters
    holds, of equals that of the longer host. rule is null and the verdict `default` where none fits. Null urls and those
    without `://` have an empty host and path and are judged like any other; repeated rows stay; an empty table gives an
    empty one, empty rules give the default; urls of any length are one row. Other columns are left out, so they can't
    clash.

    Equal (host, path) pairs are judged once, and a pair that many rows share is joined back apart (common.joined). A pair
    asks once for each of its host's last labels, as many as the longest rule's host has: the paths below every such host
    are intervals of their own.
    """
    host, path = host_and_path(F.col(url_col))
    rows = only(pages, id_col, url_col).select(id_col, host.alias("host"), path.alias("path")).withColumn("pair", F.concat("host", "path"))
    known = _known(rules)
    deepest = known.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    if deepest is None:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pairs = rows.select("host", "path").distinct()
    labels = _labels(F.col("host"))
    asked = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels))), lambda k: _key(F.slice(labels, F.lit(1), k), F.col("path")))
    changes = stack_changes(known, rows_a_block)
    events = changes.select("key", F.lit(0).alias("kind"), "top", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    events = events.unionByName(pairs.select(F.explode(asked).alias("key"), F.lit(1).alias("kind"), "host", "path"), allowMissingColumns=True)
    placed = ordered_blocks(events, ["key", "kind"], rows_a_block)
    swept = carried(placed, [], ["key", "kind"], F.when(F.col("kind") == 0, F.col("top")), "_top").filter("kind = 1")
    size = F.struct(F.length("_top.host") + F.length("_top.path"), F.length("_top.host"))
    best = swept.groupBy(F.concat("host", "path").alias("pair")).agg(F.max_by("_top", F.when(F.col("_top.host").isNotNull(), size)).alias("_rule"))
    met = joined(rows, best, "pair", hot_keys(rows, "pair"))
    return met.select(id_col, "host", "path", F.concat("_rule.host", "_rule.path").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rules_of(spark))


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (SELECT page_id, row_number() OVER () AS r, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{CAPITALS}', '{SMALL}') AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
best AS (SELECT r, arg_max((h || p, v), (length(h || p), length(h))) AS best FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM parts LEFT JOIN best USING (r)"""
