"""The relational shapes inside document conversion, over whole tables: as-of lookups, deck
order, reachability, numbering of notes, unique names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.lineage import settled


def asof_runs(points: DataFrame, runs: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """points with the value of the run that holds at each: of the runs with the same ``by``,
    that of greatest ``at`` not above the point's (a null value ends a run).

    One union and one sort by the keys, no join: rows of a key stay together, so ``by`` should
    name groups of a task's size, as documents are."""
    keys = [c for c in by]
    a = runs.select(*keys, F.col(at), F.struct(F.col(value).alias("v")).alias("_run"), F.lit(0).alias("_kind"))
    extra = [c for c in points.columns if c not in keys and c != at and c != value]
    b = points.select(*keys, F.col(at), F.lit(None).cast(a.schema["_run"].dataType).alias("_run"), F.lit(1).alias("_kind"), *extra)
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_held", F.last("_run", ignorenulls=True).over(order))
    return held.where("_kind = 1").select(*keys, at, *extra, F.col("_held.v").alias(value))


def deck_order(edges: DataFrame, slides: DataFrame, deck: str = "deck") -> DataFrame:
    """slides (deck, slide) with rank, from edges (deck, source, position, target): nodes are
    objects whose first reference to a slide names it; the object with most references to
    nodes lists the deck (of equal ones the least source). Slides without a rank come last,
    by slide."""
    first = edges.join(slides.select(deck, F.col("slide").alias("target")), [deck, "target"])
    node = first.groupBy(deck, F.col("source").alias("node")).agg(F.min_by("target", "position").alias("slide"))
    listed = edges.join(node.select(deck, F.col("node").alias("target"), "slide"), [deck, "target"])
    size = listed.groupBy(deck, "source").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy(deck).agg(F.max_by("source", F.struct("n", -F.col("source"))).alias("source"))
    rank = listed.join(best, [deck, "source"]).groupBy(deck, "slide").agg(F.min("position").alias("rank"))
    placed = slides.join(rank, [deck, "slide"], "left")
    order = Window.partitionBy(deck).orderBy(F.coalesce("rank", F.lit(1 << 62)), "slide")
    return placed.select(deck, "slide", F.row_number().over(order).alias("slide_number"))


def reachable(edges: DataFrame, roots: DataFrame, steps: int) -> DataFrame:
    """(root, node, distance) of nodes within so many edges (source, target) of roots (root).

    Each step goes on from the nodes that the one before found, and is settled, so that the
    plan grows by a scan a step; steps end early when nothing new is found."""
    edges = settled(edges.select("source", "target").distinct())
    edge = settled(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance")).distinct())
    found = edge
    for k in range(1, steps + 1):
        ahead = edge.join(edges, edge["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        edge = settled(ahead.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    return found


def number_notes(references: DataFrame, doc: str = "doc_key") -> DataFrame:
    """(doc, id, number) by first reference, from references (doc, id, position)."""
    first = references.groupBy(doc, "id").agg(F.min("position").alias("position"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("position", "id"))).drop("position")


def unique_names(images: DataFrame, doc: str = "doc_key") -> DataFrame:
    """images (doc, source_path, ...) whose file name is theirs alone in the document."""
    name = F.element_at(F.split("source_path", "/"), -1)
    own = images.withColumn("name", name)
    return own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(doc, "name"))).where("_n = 1").drop("_n")


def majority_style(paragraphs: DataFrame, runs: DataFrame, by: str = "doc_key", block: int = 1024) -> DataFrame:
    """paragraphs (doc, start, end) with the style whose runs (doc, start, end, style) overlap
    it most; of equal ones the first run's.

    Both sides are cut into blocks of so many characters and meet in these only, so that no
    document makes all its pairs; a run's parts in a paragraph are added up."""

    def cut(df: DataFrame, side: str) -> DataFrame:
        own = df.withColumnsRenamed({"start": f"{side}_start", "end": f"{side}_end"}).where(f"{side}_end > {side}_start")
        last = F.floor((F.col(f"{side}_end") - 1) / block)
        return own.withColumn("_block", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / block), last)))

    both = cut(paragraphs.select(by, "start", "end").distinct(), "p").join(cut(runs.select(by, "start", "end", "style"), "r"), [by, "_block"]).where("r_start < p_end and r_end > p_start")
    low, high = F.greatest("p_start", "r_start", F.col("_block") * block), F.least("p_end", "r_end", (F.col("_block") + 1) * block)
    parts = both.groupBy(by, "p_start", "p_end", "r_start", "r_end", "style").agg(F.sum(F.greatest(high - low, F.lit(0))).alias("part"))
    best = parts.groupBy(by, "p_start", "p_end").agg(F.max_by("style", F.struct("part", -F.col("r_start"))).alias("style"))
    best = best.withColumnsRenamed({"p_start": "start", "p_end": "end"})
    return paragraphs.join(best, [by, "start", "end"], "left")


def reading_order(boxes: DataFrame, by: str, height: float = 0.012) -> DataFrame:
    """(by, text): recognised lines (text, x, y of the lower left corner, n) from top to bottom
    in rows of a height, then from left to right, joined by line ends."""
    order = F.struct((-F.floor(F.col("y") / height)).alias("row"), "x", "n", "text")
    lines = F.array_sort(F.collect_list(F.when(F.trim("text") != "", order)))
    return boxes.groupBy(by).agg(F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("text"))
