"""Nodes, edges and communities of a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import split_description, strip
from assayer.functions.values import coverage, id_list

#: Names under which a column may be known, the first that is there counts. Fixed values.
ID_NAMES = ("id", "entity_id", "node_id")
DESCRIPTION_NAMES = ("description", "text", "summary", "content")
SOURCE_NAMES = ("source", "source_id", "head_id", "from_id")
TARGET_NAMES = ("target", "target_id", "tail_id", "to_id")
RELATION_NAMES = ("relationship", "relation", "type", "kind", "label")

GENERATED_BY = "assayer.split_nodes"


def pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in df.columns), None)


def split_nodes(nodes: DataFrame, most: int = 200) -> DataFrame:
    """Child rows of nodes whose description is longer than ``most`` characters: one for each piece, with all columns of the parent.

    Rows that are children already aren't split again, and children that are there already aren't made again, so a second run adds
    nothing. No shuffle but for that check, which only takes part where the table has children.
    """
    ident, text = pick(nodes, ID_NAMES), pick(nodes, DESCRIPTION_NAMES)
    if text is None:
        raise ValueError(f"nodes need one of the columns {', '.join(DESCRIPTION_NAMES)}")
    parent = F.col(ident).cast("string") if ident else F.xxhash64(text).cast("string")
    long = nodes.filter(F.length(strip(F.col(text))) > most)
    if "is_split_child" in nodes.columns:
        long = long.filter(~F.coalesce("is_split_child", F.lit(False)))
    # one generated row holds the pieces: a filter on them isn't pushed below it, where the splitter would run again
    pieces = long.select("*", parent.alias("__parent"), F.explode(F.array(split_description(F.col(text), most))).alias("__pieces")).filter(F.size("__pieces") > 1)
    each = pieces.select(*long.columns, "__parent", F.posexplode("__pieces").alias("__at", "__piece"))
    number = F.col("__at") + 1
    child = F.concat("__parent", F.lit("::split::"), number.cast("string"))
    made = {text: F.col("__piece"), "parent_id": F.col("__parent"), "split_index": number, "split_from": F.col("__parent"), "generated_by": F.lit(GENERATED_BY), "is_split_child": F.lit(True)}
    if ident:
        made[ident] = child
    out = each.withColumns(made).drop("__parent", "__at", "__piece")
    if "is_split_child" in nodes.columns and ident:
        out = out.join(nodes.filter("is_split_child").select(ident), ident, "left_anti")
    return out


def with_children(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """All nodes and their children; columns that only one side has are null on the other."""
    return nodes.unionByName(children, allowMissingColumns=True)


def part_of_edges(children: DataFrame, edges: DataFrame | None = None, keep_node_columns: bool = False) -> DataFrame:
    """An edge from each child to its parent, under the column names of ``edges`` and the plain ones; with the node's columns if wanted."""
    ident = pick(children, ID_NAMES)
    child, parent, kind = F.col(ident).cast("string"), F.col("parent_id"), F.lit("part_of")
    made: dict[str, Column] = {}
    if edges is not None:
        for names, value in ((SOURCE_NAMES, child), (TARGET_NAMES, parent), (RELATION_NAMES, kind)):
            if (name := pick(edges, names)) is not None:
                made[name] = value
    made |= {"source_id": child, "target_id": parent, "relationship": kind, "generated_by": F.lit(GENERATED_BY), "is_synthetic": F.lit(True)}
    rest = [c for c in children.columns if c not in made] if keep_node_columns else []
    return children.select(*rest, *(v.alias(k) for k, v in made.items()))


def split_statistics(children: DataFrame) -> DataFrame:
    return children.agg(F.count_distinct("parent_id").alias("parents_split"), F.count(F.lit(1)).alias("child_nodes"), F.count(F.lit(1)).alias("edges_added"))


def clusters(communities: DataFrame, pos: Column | None = None) -> DataFrame:
    """(cluster_id, text_unit_ids, title, level, parent, size) of communities; one without text units fails the query.

    The id is the first of id, human_readable_id and community that isn't null or empty text, or else the position; 0 is an id.
    """
    names = [n for n in ("id", "human_readable_id", "community") if n in communities.columns]
    ident = F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), (pos if pos is not None else F.lit(None)).cast("string"))
    units = id_list(F.col("text_unit_ids"))
    wrong = F.raise_error(F.concat(F.lit("community without text_unit_ids: "), F.coalesce(ident, F.lit("?")))).cast("array<string>")
    rest = [F.col(n) if n in communities.columns else F.lit(None).cast("string").alias(n) for n in ("title", "level", "parent", "period")]
    return communities.select(ident.alias("cluster_id"), F.when(F.size(units) == 0, wrong).otherwise(units).alias("text_unit_ids"), *rest, F.size(units).alias("size"))


def bridge(found: DataFrame) -> DataFrame:
    """(cluster_id, pos, unit_id)."""
    return found.select("cluster_id", F.posexplode("text_unit_ids").alias("pos", "unit_id"))


def cardinalities(**tables: DataFrame) -> DataFrame:
    """(table_name, rows)."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def unknown_relations(edges: DataFrame, allowed: list[str]) -> DataFrame:
    """(relation, n) of edges whose relation isn't one that the ontology allows."""
    relation = pick(edges, RELATION_NAMES)
    return edges.filter(~F.col(relation).isin(allowed)).groupBy(F.col(relation).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def entity_coverage(samples: DataFrame) -> DataFrame:
    """(sample_id, entity_coverage). samples: (sample_id, expected, found)."""
    return samples.select("sample_id", coverage(F.col("expected"), F.col("found")).alias("entity_coverage"))


def community_coverage(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", coverage(F.col("expected"), F.col("found")).alias("community_coverage"))


def citation_consistency(samples: DataFrame) -> DataFrame:
    """The share of cited sources that were retrieved. samples: (sample_id, citations, sources)."""
    return samples.select("sample_id", coverage(F.col("citations"), F.col("sources")).alias("citation_consistency"))


def mode_match(samples: DataFrame) -> DataFrame:
    """Whether the search mode suits the question's type. samples: (sample_id, query_type, search_mode)."""
    wanted = F.when(F.col("query_type").isin("global", "multi-hop", "comparison"), "global").otherwise("local")
    return samples.select("sample_id", (wanted == F.col("search_mode")).cast("double").alias("mode_match"))


def path_accuracy(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, graph_path_accuracy): the share of each expected path's edges that the graph has. paths: (sample_id, source, target)."""
    there = edges.select("source", "target").distinct().withColumn("there", F.lit(1.0))
    return paths.join(there, ["source", "target"], "left").groupBy("sample_id").agg(F.avg(F.coalesce("there", F.lit(0.0))).alias("graph_path_accuracy"))
