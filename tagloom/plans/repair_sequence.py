"""The fixed repair sequence over flat nodes. Order matters: captions before contents
lists, contents lists before running headers, formulas last."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom import lexicon as lx
from tagloom.operators import headings, layout, prose
from tagloom.session import cut_lineage, stored


def repaired_nodes(nodes: DataFrame, spans: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes after the automatic repairs of the node table, same schema.

    Contents runs are looked for among top-level nodes and get a TOC node of their own, which
    stands at the place of their first item; running headers go by position, so the order of
    the two does not matter. Every step contributes facts by (doc_id, ord) and all of them read one written base
    table, so the work is one pass per step however long the sequence gets.
    """
    key = ["doc_id", "ord"]
    kept = stored(layout.drop_invisible(nodes, spans), "sequence-kept")
    promoted = headings.promote_headings(kept).select(*key, F.col("new_tag").alias("_tag"))
    base = stored(kept.join(promoted, key, "left").withColumn("tag", F.coalesce("_tag", "tag")).drop("_tag"), "sequence-base")

    links = cut_lineage(layout.link_captions(base).select("doc_id", "fig", "cap"))
    figures = base.filter(F.col("tag") == "Figure").select("doc_id", F.col("ord").alias("fig"), F.col("node_id").alias("_figure"))
    captions = links.join(figures, ["doc_id", "fig"]).select("doc_id", F.col("cap").alias("ord"), "_figure")
    # a caption under its figure is no longer part of the top-level sequence
    contents = cut_lineage(layout.contents_runs(base.filter("parent_id IS NULL").join(captions, key, "left_anti")).select(*key, F.col("toc_id").alias("_toc")))
    margin = layout.header_artifacts(base, layout.running_headers(spans, pages)).select(*key, F.lit(True).alias("_margin"))
    languages = prose.node_languages(base, docs).select(*key, F.col("language").alias("_lang"))

    out = base.join(captions, key, "left").join(contents, key, "left").join(margin, key, "left").join(languages, key, "left")
    tag = F.when(F.col("_figure").isNotNull(), "Caption").when(F.col("_toc").isNotNull(), "TOCI").otherwise(F.col("tag"))
    out = out.withColumn("tag", tag)
    out = out.withColumns({
        "parent_id": F.coalesce("_figure", "_toc", "parent_id"), "artifact": F.coalesce("_margin", "artifact"),
        "language": F.when(F.col("tag").isin(lx.NODE_LANGUAGE_TAGS), F.coalesce("_lang", "language")).otherwise(F.col("language"))})
    first = contents.groupBy("doc_id", "_toc").agg(F.min("ord").alias("ord"))
    places = base.select("doc_id", "ord", "page")
    given = {"node_id": F.col("_toc"), "tag": F.lit("TOC"), "depth": F.lit(0), "artifact": F.lit(False), "decorative": F.lit(False)}
    containers = first.join(places, key).select(*[
        F.col(f.name) if f.name in ("doc_id", "ord", "page") else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return prose.tag_formulas(out).select(*nodes.columns).unionByName(containers)
