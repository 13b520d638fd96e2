"""Whole pages of a drawn diagram: from drawings and text spans to lanes of nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import amounts, slug
from lodestone.operators import geometry as P
from lodestone.operators import graph as G
from lodestone.operators.diagrams import audit_messages, merge_fragments
from lodestone.plans.scratch import materialize

# Where titles stand and how large they are, what a footer says, and margins that are close to a tie.
TITLE_BAND, TITLE_RATIO = 0.12, 1.15
FOOTER = r"(?i)\b(rev(?:ision)?\.?\s*\d|page\s*\d|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|issue\s*date|effective\s*date)\b"
LOW_MARGIN = 5.0
LISTED = 12

DRAWINGS = f"page long, draw long, items array<struct<op: string, points: {P.POINTS}>>, filled boolean, x0 double, y0 double, x1 double, y1 double"
SPANS = "page long, span long, text string, size double, x0 double, y0 double, x1 double, y1 double"


@dataclass
class Assembled:
    """nodes (page, lane, id, label, kind, pos), edges (page, lane, src, dst, condition, head_margin, pos) and
    pages (page, title, revision, spans, classified, coverage, unclassified, blank_labels, low_margin, lost_amounts, warnings)."""

    nodes: DataFrame
    edges: DataFrame
    pages: DataFrame


def page_spans(spans: DataFrame) -> DataFrame:
    """Spans (see SPANS) that say something, trimmed, sizes to a tenth, with ``place`` in reading order from 0."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    order = Window.partitionBy("page").orderBy(F.round("y0", 1), "x0", "span")
    out = spans.withColumn("text", text).where("text <> ''").withColumn("size", F.round("size", 1))
    return out.withColumn("place", F.row_number().over(order) - 1)


def shapes(drawings: DataFrame) -> DataFrame:
    """Drawings (see DRAWINGS) with ``kind`` and the ``points`` of their strokes."""
    kind = P.drawing_kind(F.col("items"), F.col("filled"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return drawings.withColumn("kind", kind).withColumn("points", P.polyline(F.col("items")))


def boxes_of(shaped: DataFrame) -> DataFrame:
    """(page, box, kind, x0, y0, x1, y1): steps, then decisions, then junctions, each in order of drawing; box from 0 on a page."""
    rects = F.transform(F.filter("items", lambda x: (x["op"] == "re") & P.holds_label(x)), lambda x: x["points"])
    corner = lambda f, c: f(F.col("r")[0][c], F.col("r")[1][c])
    steps = shaped.where("kind = 'node'").select("page", "draw", F.posexplode(rects).alias("n", "r"))
    steps = steps.select("page", "draw", "n", F.lit("step").alias("kind"), corner(F.least, "x").alias("x0"), corner(F.least, "y").alias("y0"), corner(F.greatest, "x").alias("x1"), corner(F.greatest, "y").alias("y1"))
    kind = F.when(F.col("kind") == "diamond", "decision").otherwise("junction")
    rest = shaped.where("kind in ('diamond', 'junction')").select("page", "draw", F.lit(0).alias("n"), kind.alias("kind"), "x0", "y0", "x1", "y1")
    rank = F.when(F.col("kind") == "step", 0).when(F.col("kind") == "decision", 1).otherwise(2)
    order = Window.partitionBy("page").orderBy(rank, "draw", "n")
    every = steps.unionByName(rest)
    return every.withColumn("box", (F.row_number().over(order) - 1).cast("long")).select("page", "box", "kind", "x0", "y0", "x1", "y1")


def _listed(order: str, value: str, when: Column | None = None) -> Column:
    row = F.struct(order, value)
    return F.transform(F.array_sort(F.collect_list(row if when is None else F.when(when, row))), lambda x: x[value])


#: A name that another slug may have been given: a slug and a number from 2.
NUMBERED_ID = "^(.+)_([2-9]|[1-9][0-9]+)$"


def unique_ids(rows: DataFrame, page: str, order: str) -> DataFrame:
    """``rows`` (page, order, slug) with ``id``: the slug, with a number from _2 behind those that were there before on the page.

    A name so made is taken too, as in :func:`lodestone.functions.text.unique_slugs`, but no page is one
    array. Made names can meet only slugs of the page that end in a number themselves: where a page has a
    slug and one that it may become, all of that beginning go through the names one by one; all other rows are just counted.
    """
    known = rows.select(F.col(page).alias("_page"), "slug").distinct()
    pairs = known.select("_page", F.col("slug").alias("made"), F.regexp_extract("slug", NUMBERED_ID, 1).alias("slug")).where("slug <> ''").join(known.withColumnRenamed("_page", "_p"), ["slug"]).where(F.col("_page").eqNullSafe(F.col("_p")))
    met = pairs.select("_page", F.explode(F.array("slug", "made")).alias("_slug")).distinct().withColumn("_met", F.lit(True))
    marked = rows.join(met, F.col(page).eqNullSafe(F.col("_page")) & (F.col("slug") == F.col("_slug")), "left").drop("_page", "_slug")
    nth = F.row_number().over(Window.partitionBy(page, "slug").orderBy(order))
    alone = marked.where("_met is null").drop("_met").withColumn("_n", nth).withColumn("id", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("_n").cast("string")))).drop("_n")

    columns = alone.columns

    def run(g: pd.DataFrame) -> pd.DataFrame:
        taken, last, ids = set(), {}, []
        g = g.sort_values(order)
        for s in g["slug"]:
            name = s
            if s in taken:
                n = last.get(s, 2)
                while f"{s}_{n}" in taken:
                    n += 1
                last[s] = n
                name = f"{s}_{n}"
            taken.add(name)
            ids.append(name)
        return g.assign(id=ids)[columns]

    stem = F.regexp_replace("slug", "(_[0-9]+)+$", "").alias("_stem")
    return alone.unionByName(marked.where("_met").drop("_met").groupBy(page, stem).applyInPandas(run, alone.schema))


def assemble(drawings: DataFrame, spans: DataFrame, pages: DataFrame) -> Assembled:
    """Pages (page, height, title_hint) as graphs; no step looks at more than one page, and none asks a model.

    Shapes are told apart, fragments of connectors joined, spans put in boxes or on connectors, ends
    snapped to boxes and directed by arrowheads, junctions contracted, and components made lanes. What
    belongs to nothing is a footer, a title or the head of a lane, or else counts as unclassified.
    """
    shaped = materialize(shapes(drawings), "shapes")
    boxes = materialize(boxes_of(shaped), "boxes")
    real = boxes.where("kind <> 'junction'")
    heads = shaped.where("kind = 'arrowhead'").select("page", ((F.col("x0") + F.col("x1")) / 2).alias("hx"), ((F.col("y0") + F.col("y1")) / 2).alias("hy"))
    lines = shaped.where((F.col("kind") == "connector") & (F.size("points") >= 2))
    end = lambda i, c: F.element_at("points", i)[c]
    pieces = lines.select("page", F.col("draw").alias("conn"), end(1, "x").alias("ax"), end(1, "y").alias("ay"), end(-1, "x").alias("bx"), end(-1, "y").alias("by"), F.lit("").alias("label"))
    merged = materialize(merge_fragments(pieces, real.drop("kind")), "connectors")
    member = merged.select("page", "conn", F.explode("members").alias("member"))
    parts = P.segments_of(lines).withColumnRenamed("conn", "member").join(member, ["page", "member"]).drop("member")

    # --- text: in a box, on a connector, or neither
    said = materialize(page_spans(spans), "spans")
    inside = materialize(P.assign_text(said, real), "inside")
    labels = inside.join(said.select("page", "span", "place", "text"), ["page", "span"]).groupBy("page", "box").agg(F.array_join(_listed("place", "text"), " ").alias("label"))
    clusters = materialize(P.cluster_spans(said.join(inside, ["page", "span"], "left_anti")), "clusters")
    centre = clusters.select("page", "cluster", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    near = materialize(P.attach_labels(centre, parts), "attached")
    condition = near.join(clusters.select("page", "cluster", "text"), ["page", "cluster"]).groupBy("page", "conn").agg(F.array_join(_listed("cluster", "text"), " ").alias("condition"))

    # --- edges between boxes, through junctions
    kinds = boxes.join(labels, ["page", "box"], "left").select("page", "box", "kind", F.coalesce("label", F.lit("")).alias("label"))
    straight = P.direct_edges(merged.select("page", "conn", "ax", "ay", "bx", "by"), boxes.drop("kind"), heads).join(condition, ["page", "conn"], "left")
    nodes = kinds.select(F.col("page").alias("graph"), F.col("box").alias("id"), "label", "kind", F.col("box").alias("pos"))
    work = straight.select(F.col("page").alias("graph"), "src", "dst", "condition", "head_margin", F.col("conn").alias("pos"))
    routed = G.contract_junctions(nodes, work).withColumn("pos", F.monotonically_increasing_id())
    joined = materialize(G.union_conditions(routed).withColumn("pos", F.struct("src", "dst")), "edges")

    # --- names and lanes
    real_nodes = unique_ids(kinds.where("kind <> 'junction'").withColumn("slug", slug(F.col("label"))), "page", "box").drop("slug")
    lanes = G.lanes(real_nodes.select(F.col("page").alias("graph"), F.col("box").alias("id"), F.col("box").alias("pos")), joined.where("src <> dst"))
    number = F.dense_rank().over(Window.partitionBy("graph").orderBy("lane"))
    lanes = lanes.withColumn("k", number).withColumn("of", F.max("k").over(Window.partitionBy("graph")))
    lane = F.when(F.col("of") == 1, F.lit("Approval flow")).otherwise(F.concat(F.lit("Approval flow "), F.col("k").cast("string")))
    placed = lanes.select(F.col("graph").alias("page"), F.col("id").alias("box"), lane.alias("lane"))
    real_nodes = materialize(real_nodes.select("page", "box", "id", "label", "kind").join(placed, ["page", "box"]), "nodes")
    at = lambda c: real_nodes.select(F.col("page").alias("graph"), F.col("box").alias(c), F.col("id").alias(f"{c}_id"), F.col("lane").alias(f"{c}_lane"))
    edges = joined.join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"])
    edges = edges.select(F.col("graph").alias("page"), F.col("src_lane").alias("lane"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "condition", "head_margin", F.col("pos"))
    edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1)
    nodes = real_nodes.select("page", "lane", "id", "label", "kind", F.col("box").alias("pos"))
    return Assembled(nodes, edges, _facts(pages, said, inside, near, clusters, nodes, edges))


def _facts(pages: DataFrame, said: DataFrame, inside: DataFrame, near: DataFrame, clusters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    body = said.groupBy("page").agg(F.median("size").alias("body"), F.count(F.lit(1)).alias("spans"))
    loose = clusters.join(near.select("page", "cluster"), ["page", "cluster"], "left_anti").join(body.select("page", "body"), "page").join(pages.select("page", "height"), "page")
    top = F.col("y0") <= F.col("height") * TITLE_BAND
    role = F.when(F.col("text").rlike(FOOTER), "footer").when(top & (F.col("size") >= F.col("body") * TITLE_RATIO), "title").when(top, "lane")
    loose = loose.withColumn("role", role)
    first = lambda kind: F.get(_listed("cluster", "text", F.col("role") == kind), F.lit(0))
    heads = loose.groupBy("page").agg(first("footer").alias("revision"), first("title").alias("own_title"))
    lost = loose.where("role is null").select("page", F.explode("spans").alias("span")).join(said.select("page", "span", "place", "text"), ["page", "span"])
    lost = lost.groupBy("page").agg(F.count(F.lit(1)).alias("open"), F.slice(_listed("place", "text"), 1, LISTED).alias("unclassified"))
    on_page = said.select("page", F.explode(amounts(F.col("text"))).alias("amount")).distinct()
    held = nodes.select("page", F.col("label").alias("t")).unionByName(edges.select("page", F.col("condition").alias("t"))).select("page", F.explode(amounts(F.col("t"))).alias("amount")).distinct()
    gone = on_page.join(held, ["page", "amount"], "left_anti").groupBy("page").agg(F.array_sort(F.collect_list("amount")).alias("lost_amounts"))
    blank = nodes.groupBy("page").agg(F.count_if(F.col("label") == "").alias("blank_labels"))
    weak = edges.where(F.col("head_margin") < LOW_MARGIN).withColumn("arrow", F.concat("src", F.lit("->"), "dst")).groupBy("page").agg(_listed("pos", "arrow").alias("low_margin"))
    out = pages.select("page", "title_hint")
    for part in (body.select("page", "spans"), heads, lost, gone, blank, weak):
        out = out.join(part, "page", "left")
    none = F.array().cast("array<string>")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda c: F.coalesce(F.col(c), none)
    classified = n("spans") - n("open")
    out = out.select(
        "page", F.coalesce("title_hint", "own_title").alias("title"), "revision", n("spans").alias("spans"), classified.alias("classified"),
        F.when(n("spans") > 0, F.round(classified / n("spans"), 4)).otherwise(F.lit(1.0)).alias("coverage"), some("unclassified").alias("unclassified"),
        n("blank_labels").alias("blank_labels"), some("low_margin").alias("low_margin"), some("lost_amounts").alias("lost_amounts"),
    )
    warned = audit_messages(F.col("spans"), F.col("spans") - F.col("classified"), F.col("blank_labels"), F.size("low_margin"), F.col("lost_amounts"))
    return out.withColumn("warnings", warned)


def page_chunks(made: Assembled) -> DataFrame:
    """(page, section, text): every lane of :func:`assemble` as prose, with the thresholds of its page."""
    key = F.concat_ws("|", F.col("page").cast("string"), F.col("lane")).alias("graph")
    nodes, edges = made.nodes.select(key, "page", "lane", "id", "label", "kind", "pos"), made.edges.select(key, "page", "src", "dst", "condition", "pos")
    lanes = nodes.select("graph", "page", "lane").distinct()
    of_page = G.escalation(nodes, edges).join(lanes.select("graph", "page"), "graph").select("page", "pos", "condition", "approver")
    facts = lanes.join(made.pages.select("page", "title", "revision"), "page").select("graph", "title", F.col("lane").alias("name"), "revision")
    text = G.render_prose(nodes, edges, facts, lanes.select("graph", "page").join(of_page, "page").drop("page"))
    return text.join(lanes, "graph").select("page", F.col("lane").alias("section"), "text")
