"""OCR and vision output to tables.

A document is one row with an array of blocks. Per-document sums, line lists and references between blocks
(key to value, cell to words) use array functions in place. Documents that take many look-ups, and those whose id
is null or in several rows, are resolved by windows over (document, block id), after one exchange that brings a
document's blocks together; both ways give the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.functions import paths as P
from tenantlake.functions import scalars as S
from tenantlake.session import stage

# Confidence needed to skip manual review, and header fields of a certificate.
CONFIDENCE_THRESHOLD = 0.85
CERTIFICATE_FIELDS = ("Product Name", "Batch / Lot", "Mfg Date", "Expiry Date", "Quantity", "Disposition:",
                      "Analyst", "QA Approver")

DOC = "doc_id"
LINKED_TYPES = ("WORD", "CELL", "TABLE", "KEY_VALUE_SET")
_TABLE_KINDS = ("CELL", "TABLE")
#: Blocks and links of a document that is resolved in its row, where a look-up goes through the blocks.
IN_ROW = 1_024


def line_texts(blocks: Column) -> Column:
    """Texts of the LINE blocks, in order."""
    return F.transform(F.filter(blocks, lambda b: b["BlockType"] == "LINE"),
                       lambda b: F.coalesce(b["Text"], F.lit("")))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text)."""
    return docs.select(DOC, F.posexplode(line_texts(F.col("blocks"))).alias("line_no", "text"))


def block_confidence(blocks: Column) -> Column:
    """Mean confidence of the scored blocks on 0-1, four decimals; none gives 0."""
    scored = F.transform(F.filter(blocks, lambda b: b["Confidence"].isNotNull()), lambda b: b["Confidence"] / 100)
    total = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scored) > 0, S.round_to(total / F.size(scored), 4)).otherwise(0.0)


def percent_confidence(blocks: Column) -> Column:
    """The same mean on 0-100, two decimals."""
    scored = F.transform(F.filter(blocks, lambda b: b["Confidence"].isNotNull()), lambda b: b["Confidence"])
    total = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scored) > 0, S.round_to(total / F.size(scored), 2)).otherwise(0.0)


def confidence(docs: DataFrame) -> DataFrame:
    return docs.withColumn("confidence", block_confidence(F.col("blocks")))


def stage_blocks(docs: DataFrame) -> DataFrame:
    """The blocks that refer to each other, one per row, a document's blocks in one partition.

    This is the one exchange of blocks: whatever is grouped by document and something else afterwards is already
    in place. A document was one row to begin with, so what a task gets of one is bounded by a row. The documents
    are read once by each result built on the blocks; ``resolved`` gives fields and cells in one.
    """
    long = docs.select(DOC, F.posexplode("blocks").alias("pos", "b")).where(F.col("b.BlockType").isin(*LINKED_TYPES))
    return long.select(DOC, "pos", *[F.col(f"b.{c}").alias(c) for c in (
        "Id", "BlockType", "Text", "RowIndex", "ColumnIndex", "EntityTypes", "Relationships")]).repartition(DOC)


_LINK = "struct<rel_no:int,child_no:int,id:string>"


def _links(kind: str) -> Column:
    """A block's links of one relationship type as an array of (rel_no, child_no, id)."""
    numbered = F.transform("Relationships", lambda rel, i: F.when(rel["Type"] == kind, F.transform(
        rel["Ids"], lambda child, j: F.struct(i.alias("rel_no"), j.alias("child_no"), child.alias("id")))))
    return F.coalesce(F.flatten(F.filter(numbered, lambda x: x.isNotNull())), F.array().cast(f"array<{_LINK}>"))


def _in_document(key: str) -> Window:
    """Rows of one document with equal keys; needs no exchange, since a document's rows are together."""
    return Window.partitionBy(DOC, key)


def _with_texts(blocks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The blocks of ``kinds`` with the text of their words: (doc_id, pos, block_id, kind, row, col, is_key, refs, text).

    ``text`` is null for a block without words. ``refs`` are the links to follow next: a table's cells, a key's
    last value. Each word meets the blocks that name it by a window over (document, word id); of words with one
    id the last counts.
    """
    kind = F.col("BlockType")
    ref = F.when(kind == "TABLE", _links("CHILD")).when(
        F.array_contains("EntityTypes", "KEY"), F.slice(F.reverse(_links("VALUE")), 1, 1))
    none = F.lit(None).cast(_LINK)
    words = F.when(kind.isin("TABLE"), F.array(none)).otherwise(F.concat(F.array(none), _links("CHILD")))
    linked = blocks.where(kind.isin(*kinds, "WORD")).select(
        DOC, "pos", F.col("Id").alias("block_id"), kind.alias("kind"), F.coalesce("RowIndex", F.lit(0)).alias("row"),
        F.coalesce("ColumnIndex", F.lit(0)).alias("col"), F.coalesce(F.array_contains("EntityTypes", "KEY"), F.lit(False)).alias("is_key"),
        F.coalesce(ref, F.array().cast(f"array<{_LINK}>")).alias("refs"), "Text",
        F.explode(F.when(kind == "WORD", F.array(none)).otherwise(words)).alias("link"))
    is_word = F.col("kind") == "WORD"
    met = linked.withColumn("_key", F.when(is_word, F.col("block_id")).otherwise(F.col("link.id"))).withColumn(
        "_word", F.max(F.when(is_word & F.col("_key").isNotNull(), F.struct("pos", F.coalesce("Text", F.lit("")).alias("word")))).over(
            _in_document("_key")))
    word = F.when(F.col("_key").isNotNull() & F.col("_word").isNotNull(), F.struct("link.rel_no", "link.child_no", "_word.word"))
    # a block's words were one array inside one block to begin with; nulls are not collected
    ordered = F.array_sort(F.collect_list(word))
    text = F.when(F.size(ordered) > 0, F.array_join(F.transform(ordered, lambda w: w["word"]), " "))
    return met.where(~is_word).groupBy(DOC, "pos", "block_id", "kind").agg(
        *[F.first(c).alias(c) for c in ("row", "col", "is_key", "refs")], text.alias("text"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: inside a lambda it is a variable, not the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _find(ids: Column, values: Column, key: Column) -> Column:
    """The value at the first place of the key among the ids; null for none."""
    return F.get(values, (F.array_position(ids, key) - 1).cast("int"))


def _link_ids(block: Column, kind: str) -> Column:
    """Ids of a block's links of one relationship type, in order."""
    found = F.transform(block["Relationships"], lambda rel: F.when(rel["Type"] == kind, rel["Ids"]))
    return F.coalesce(F.flatten(F.filter(found, lambda ids: ids.isNotNull())), F.array().cast("array<string>"))


def _last_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items without those whose key comes again."""
    return _let(items, lambda xs: _let(F.reverse(F.transform(xs, key)), lambda keys: F.filter(
        xs, lambda x, i: F.array_position(keys, key(x)) == F.size(xs) - i)))


def _texts_in_row(blocks: Column, kinds: tuple[str, ...]) -> Column:
    """``_with_texts`` of one document as an array."""
    words = F.filter(F.reverse(blocks), lambda b: b["BlockType"] == "WORD")

    def one(pos: Column, b: Column, words: Column) -> Column:
        kind, is_key = b["BlockType"], F.coalesce(F.array_contains(b["EntityTypes"], "KEY"), F.lit(False))
        own = F.filter(F.transform(_link_ids(b, "CHILD"), lambda i: _find(words["ids"], words["texts"], i)), lambda w: w.isNotNull())
        refs = F.when(kind == "TABLE", _link_ids(b, "CHILD")).when(
            (kind == "KEY_VALUE_SET") & is_key, F.slice(F.reverse(_link_ids(b, "VALUE")), 1, 1))
        return F.struct(
            pos.alias("pos"), b["Id"].alias("block_id"), kind.alias("kind"), F.coalesce(b["RowIndex"], F.lit(0)).alias("row"),
            F.coalesce(b["ColumnIndex"], F.lit(0)).alias("col"), is_key.alias("is_key"), refs.alias("refs"),
            F.when(kind != "TABLE", _let(own, lambda ws: F.when(F.size(ws) > 0, F.array_join(ws, " ")))).alias("text"))

    return _let(
        _let(words, lambda ws: F.struct(ws["Id"].alias("ids"), F.transform(ws["Text"], lambda t: F.coalesce(t, F.lit(""))).alias("texts"))),
        lambda ws: F.filter(F.transform(blocks, lambda b, i: F.when(b["BlockType"].isin(*kinds), one(i, b, ws))), lambda e: e.isNotNull()))


def _found_in_row(blocks: Column, kinds: tuple[str, ...]) -> Column:
    """``resolved`` of one document: its fields (key, value) and cells (pos, row, col, text), both as arrays."""
    def fields(ends: Column, to: Column) -> Column:
        keys = F.filter(ends, lambda e: e["is_key"] & (e["kind"] == "KEY_VALUE_SET") & (F.coalesce(e["text"], F.lit("")) != ""))
        value = lambda e: _let(_find(to["ids"], to["ends"], F.get(e["refs"], F.lit(0))), lambda v: F.coalesce(
            F.when(v["kind"] == "KEY_VALUE_SET", v["text"]), F.lit("")))
        return _last_of(F.transform(keys, lambda e: F.struct(e["text"].alias("key"), value(e).alias("value"))), lambda f: f["key"])

    def cells(table: Column, to: Column) -> Column:
        there = F.filter(F.transform(table["refs"], lambda i: _find(to["ids"], to["ends"], i)), lambda c: c["kind"] == "CELL")
        return _last_of(F.transform(there, lambda c: F.struct(
            table["pos"].alias("pos"), c["row"].alias("row"), c["col"].alias("col"), F.coalesce(c["text"], F.lit("")).alias("text"))),
            lambda c: F.struct(c["row"], c["col"]))

    def both(ends: Column) -> Column:
        can = F.filter(F.reverse(ends), lambda e: e["kind"].isin("CELL", "KEY_VALUE_SET"))
        to = _let(can, lambda es: F.struct(es["block_id"].alias("ids"), es.alias("ends")))
        return _let(to, lambda t: F.struct(fields(ends, t).alias("fields"), F.flatten(F.transform(
            F.filter(ends, lambda e: e["kind"] == "TABLE"), lambda e: cells(e, t))).alias("cells")))

    return _let(_texts_in_row(blocks, kinds), both)


def _lines_in_row(found: Column) -> Column:
    """A document's table rows in order: (table_no, row, by_col), with (col, text) in column order."""
    lines = F.array_sort(F.array_distinct(F.transform(found["cells"], lambda c: F.struct(c["pos"].alias("table_no"), c["row"].alias("row")))))
    return F.transform(lines, lambda at: F.struct(at["table_no"].alias("table_no"), at["row"].alias("row"), F.array_sort(F.transform(
        F.filter(found["cells"], lambda c: (c["pos"] == at["table_no"]) & (c["row"] == at["row"])),
        lambda c: F.struct(c["col"].alias("col"), c["text"].alias("text")))).alias("by_col")))


def _work(blocks: str) -> Column:
    """Blocks and links of a document."""
    return F.coalesce(F.aggregate(F.col(f"{blocks}.Relationships"), F.lit(0), lambda n, rels: n + 1 + F.coalesce(
        F.aggregate(rels["Ids"], F.lit(0), lambda k, ids: k + F.coalesce(F.size(ids), F.lit(0))), F.lit(0))), F.lit(0))


def dealt(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents that are resolved in their rows, and the others, None without any.

    The others have more than ``IN_ROW`` blocks and links, a null id, or an id that is in several rows. Only ids
    are exchanged to know them.
    """
    counted = docs.groupBy(DOC).agg(F.count(F.lit(1)).alias("n"), F.max(_work("blocks")).alias("work"))
    others = stage(counted.where(F.col(DOC).isNull() | (F.col("n") > 1) | (F.col("work") > IN_ROW)).select(F.col(DOC).alias("_other")), "others")
    if others.isEmpty():
        return docs, None
    same = F.col(DOC).eqNullSafe(F.col("_other"))
    return docs.join(others, same, "left_anti"), docs.join(others, same, "left_semi")


def _either(blocks: DataFrame, in_row: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``long`` of staged blocks; of documents ``in_row`` where it can be, and ``long`` for the others."""
    if "blocks" not in blocks.columns:
        return long(blocks)
    easy, others = dealt(blocks)
    return in_row(easy) if others is None else in_row(easy).unionByName(long(stage_blocks(others)))


def block_text(blocks: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, block_id, text): WORD children joined by spaces, in child order.

    ``blocks`` are documents (doc_id, blocks), or blocks from ``stage_blocks``, here and below. Blocks without words
    are absent; callers coalesce to ''.
    """
    kinds = kinds or ("CELL", "KEY_VALUE_SET")
    texts = lambda docs: docs.select(DOC, F.inline(F.transform(
        F.filter(_texts_in_row(F.col("blocks"), tuple(k for k in kinds if k in LINKED_TYPES and k != "WORD")), lambda e: e["text"].isNotNull()),
        lambda e: F.struct(e["block_id"].alias("block_id"), e["text"].alias("text")))))
    return _either(blocks, texts, lambda long: _with_texts(long, kinds).where(F.col("text").isNotNull()).select(DOC, "block_id", "text"))


def resolved(blocks: DataFrame, *kinds: str) -> DataFrame:
    """Form fields and table cells: (doc_id, kind, pos, key, row, col, text).

    A ``KEY_VALUE_SET`` row is a field, with its key and value; a ``TABLE`` row a cell of the table at block ``pos``.
    Fields without a key text are dropped; of equal keys, and of equal cells of a table, the last wins. Links to
    blocks that aren't there give '' (a value) or nothing (a cell); of blocks with one id the last counts.
    """
    kinds = kinds or ("KEY_VALUE_SET", "CELL", "TABLE")
    own = F.lit(None).cast(_LINK)
    ends = _with_texts(blocks, kinds).select("*", F.explode(F.concat(F.array(own), F.col("refs"))).alias("ref"))
    is_self = F.col("ref").isNull()
    can = F.col("_key").isNotNull() & is_self & F.col("kind").isin("CELL", "KEY_VALUE_SET")
    met = ends.withColumn("_key", F.when(is_self, F.col("block_id")).otherwise(F.col("ref.id"))).withColumn(
        "_to", F.max(F.when(can, F.struct("pos", F.col("kind").alias("what"), F.col("row").alias("r"), F.col("col").alias("c"), F.coalesce("text", F.lit("")).alias("t")))).over(
            _in_document("_key")))
    there = F.col("_key").isNotNull() & F.col("_to").isNotNull() & (
        F.col("_to.what") == F.when(F.col("kind") == "TABLE", "CELL").otherwise(F.col("kind")))
    is_field = F.col("is_key") & (F.col("kind") == "KEY_VALUE_SET") & (F.coalesce("text", F.lit("")) != "")
    # a key without a value has no link to follow, so its own row stands for it
    value = F.when(is_self, F.lit("")).otherwise(F.when(there, F.col("_to.t")).otherwise(""))
    is_cell = ~is_self & there & (F.col("kind") == "TABLE")
    out = met.where(is_cell | is_field & (~is_self | (F.size("refs") == 0))).select(
        DOC, "kind", "pos", F.when(F.col("kind") == "TABLE", F.lit(None)).otherwise(F.col("text")).alias("key"),
        F.when(F.col("kind") == "TABLE", F.col("_to.r")).alias("row"), F.when(F.col("kind") == "TABLE", F.col("_to.c")).alias("col"),
        F.when(F.col("kind") == "TABLE", F.col("_to.t")).otherwise(value).alias("text"),
        F.struct("pos", "ref.rel_no", "ref.child_no").alias("place"))
    # a field is its document's by its key, a cell its table's by row and column
    of = F.when(F.col("kind") == "TABLE", F.col("pos")).otherwise(-1)
    return out.withColumn("of", of).groupBy(DOC, "kind", "of", "key", "row", "col").agg(
        F.max_by("text", "place").alias("text")).select(DOC, "kind", F.col("of").alias("pos"), "key", "row", "col", "text")


def _fields(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == "KEY_VALUE_SET").select(DOC, "key", F.col("text").alias("value"))


def _cells(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == "TABLE").select(DOC, F.col("pos").alias("table_no"), "row", "col", "text")


def forms(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the form fields; empty keys dropped, the last of equal keys wins."""
    return _either(blocks, lambda docs: docs.select(DOC, F.inline(_found_in_row(F.col("blocks"), ("KEY_VALUE_SET",))["fields"])),
                   lambda long: _fields(resolved(long, "KEY_VALUE_SET")))


def cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, col, text): table_no is the block position; the last of equal cells wins."""
    return _either(
        blocks, lambda docs: docs.select(DOC, F.inline(_found_in_row(F.col("blocks"), _TABLE_KINDS)["cells"])).withColumnRenamed("pos", "table_no"),
        lambda long: _cells(resolved(long, *_TABLE_KINDS)))


def table_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, cells): the matrix form, a row's texts in column order.

    ``by_col`` keeps the texts under their column index. One table row is collected at a time.
    """
    def in_row(docs: DataFrame) -> DataFrame:
        lines = docs.select(DOC, F.inline(_let(_found_in_row(F.col("blocks"), _TABLE_KINDS), _lines_in_row)))
        return lines.select(DOC, "table_no", "row", F.col("by_col.text").alias("cells"), F.map_from_entries("by_col").alias("by_col"))

    return _either(blocks, in_row, lambda long: _rows_of(cells(long)))


def _rows_of(found: DataFrame) -> DataFrame:
    by_col = F.array_sort(F.collect_list(F.struct("col", "text")))
    return found.groupBy(DOC, "table_no", "row").agg(
        F.transform(by_col, lambda c: c["text"]).alias("cells"), F.map_from_entries(by_col).alias("by_col"))


def _records(rows: DataFrame) -> DataFrame:
    of_table = Window.partitionBy(DOC, "table_no")
    body = rows.withColumns({"first_row": F.min("row").over(of_table), "header": F.min_by("cells", "row").over(of_table)}).where(
        F.col("row") > F.col("first_row"))
    return body.select(DOC, "table_no", "row", _record(F.col("header"), F.col("by_col")).alias("record"))


def _record(header: Column, by_col: Column) -> Column:
    names = F.array_distinct(header)
    last_at = F.transform(names, lambda h: F.size(header) - F.array_position(F.reverse(header), h) + 1)
    values = F.transform(last_at, lambda i: F.coalesce(F.try_element_at(by_col, i.cast("int")), F.lit("")))
    return F.map_from_arrays(names, values)


def table_records(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, record): each later row as a map under the first row's texts.

    Header names are taken by place; cells are read at column 1, 2, ... whatever the header's own
    columns were; of equal header names the last wins.
    """
    def body(lines: Column) -> Column:
        # lines are in order, so a table's first is its header
        headed = F.transform(lines, lambda x: F.struct(x.alias("line"), F.get(
            F.filter(lines, lambda y: y["table_no"] == x["table_no"]), F.lit(0)).alias("head")))
        return F.transform(F.filter(headed, lambda x: x["line"]["row"] > x["head"]["row"]), lambda x: F.struct(
            x["line"]["table_no"].alias("table_no"), x["line"]["row"].alias("row"), x["line"]["by_col"].alias("by_col"),
            x["head"]["by_col"]["text"].alias("header")))

    def in_row(docs: DataFrame) -> DataFrame:
        lines = docs.select(DOC, F.inline(_let(_found_in_row(F.col("blocks"), _TABLE_KINDS), lambda f: _let(_lines_in_row(f), body))))
        return lines.select(DOC, "table_no", "row", _record(F.col("header"), F.map_from_entries("by_col")).alias("record"))

    return _either(blocks, in_row, lambda long: _records(table_rows(long)))


def matrices(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_no, matrix): one row per table, as large as the table was in its document."""
    return table_rows(blocks).groupBy(DOC, "table_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("matrix"))


def record_tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_no, records): the row-map form, one row per table; a header alone has no records."""
    # sorted by row; maps cannot be compared, so the record travels as text
    return table_records(blocks).groupBy(DOC, "table_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row", F.to_json("record").alias("record")))),
        lambda r: F.from_json(r["record"], "map<string,string>")).alias("records"))


def labels_and_text(df: DataFrame) -> DataFrame:
    """Vision output (labels, text_detections) to detected labels, LINE texts and their mean confidence on 0-1."""
    def scaled(x: Column) -> Column:
        return S.round_to(F.coalesce(x["Confidence"], F.lit(0.0)) / 100, 4).alias("confidence")

    found = F.transform("labels", lambda x: F.struct(F.coalesce(x["Name"], F.lit("")).alias("name"), scaled(x)))
    text = F.transform(F.filter("text_detections", lambda x: x["Type"] == "LINE"), lambda x: F.struct(
        F.coalesce(x["DetectedText"], F.lit("")).alias("text"), scaled(x)))
    out = df.withColumn("detected_labels", found).withColumn("detected_text", text)
    scores = F.concat(F.transform("detected_labels", lambda x: x["confidence"]),
                      F.transform("detected_text", lambda x: x["confidence"]))
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.size(scores)
    return out.withColumn("confidence", F.when(F.size(scores) > 0, S.round_to(mean, 4)).otherwise(0.0))


def route(df: DataFrame, bucket: str, at: Column, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Adds ``destination``, ``destination_path`` and ``needs_review`` to (cmo_id, data_domain, confidence) rows."""
    good = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    to_bronze = P.layer_path(bucket, "bronze", F.col("cmo_id"), F.col("data_domain"), at)
    to_review = P.review_path(bucket, F.col("cmo_id"), F.col("data_domain"), at)
    return df.withColumns({
        "destination": F.when(good, "bronze").otherwise("manual_review"),
        "destination_path": F.when(good, to_bronze).otherwise(to_review),
        "needs_review": ~good,
    })


def result_key(original_key: Column, good: Column, lot: Column, at: Column) -> Column:
    """Key of a saved result: beside ``incoming/``, under the lot (or batch) and day, or manual-review."""
    parts = F.split(original_key, "/incoming/", 2)
    base, rest = F.get(parts, F.lit(0)), F.split(F.get(parts, F.lit(1)), "/")
    batch = F.when(F.size(rest) >= 3, F.get(rest, F.lit(0)))
    label = F.coalesce(F.when(lot != "", lot), batch)
    name = F.concat(S.file_stem(original_key), F.lit(".json"))
    slot = F.when(label.isNotNull(), F.concat(F.lit("/lot="), label, F.lit("/"))).otherwise("/")
    return F.when(good, F.concat(base, slot, P.day_levels(at), name)).otherwise(
        F.concat(base, F.lit("/manual-review/"), name))


def with_source(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Finished jobs with their original file's metadata; jobs without any are dropped."""
    return docs.join(jobs, "job_id")


def _forms_and_tables(found: Column) -> Column:
    matrix = lambda lines, t: F.transform(F.filter(lines, lambda x: x["table_no"] == t), lambda x: x["by_col"]["text"])
    tables = _let(_lines_in_row(found), lambda lines: F.transform(
        F.array_distinct(F.transform(lines, lambda x: x["table_no"])), lambda t: matrix(lines, t)))
    return F.struct(F.map_from_entries(found["fields"]).alias("forms"), tables.alias("tables"))


def _whole(blocks: DataFrame) -> DataFrame:
    """(doc_id, forms, tables), a row a document."""
    found = resolved(blocks)
    # a document's rows are in one place: its tables' cells, then its fields and tables, are grouped where they are
    by_col = F.array_sort(F.collect_list(F.struct("col", "text")))
    is_field = F.col("kind") == "KEY_VALUE_SET"
    lined = found.groupBy(DOC, "kind", "pos", "key", "row").agg(
        F.transform(by_col, lambda c: c["text"]).alias("cells"))
    tables = lined.groupBy(DOC, "kind", "pos").agg(
        F.collect_list(F.when(is_field, F.struct("key", F.get("cells", F.lit(0)).alias("value")))).alias("fields"),
        F.transform(F.array_sort(F.collect_list(F.when(~is_field, F.struct("row", "cells")))), lambda r: r["cells"]).alias("matrix"))
    return tables.groupBy(DOC).agg(
        F.map_from_entries(F.flatten(F.collect_list("fields"))).alias("forms"),
        F.transform(F.array_sort(F.collect_list(F.when(~is_field, F.struct("pos", "matrix")))), lambda t: t["matrix"]).alias("tables"))


def process_documents(docs: DataFrame, bucket: str, at: Column,
                      threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per document: text lines, tables, forms, confidence and destination.

    ``docs``: (doc_id, cmo_id, data_domain, file_key, blocks). Forms and tables are made in the document's row; those
    of the documents that ``dealt`` sets apart come of one pass over their blocks and are put back with one join. A
    document's output is no larger than the row it came from.
    """
    known = [line_texts(F.col("blocks")).alias("lines"), block_confidence(F.col("blocks")).alias("confidence"),
             F.coalesce(F.size("blocks"), F.lit(0)).alias("block_count")]
    easy, others = dealt(docs)
    done = easy.select(DOC, "cmo_id", "data_domain", "file_key", *known, _let(
        _found_in_row(F.col("blocks"), ("KEY_VALUE_SET", *_TABLE_KINDS)), _forms_and_tables).alias("found")).select("*", "found.*").drop("found")
    if others is not None:
        base = others.select(DOC, "cmo_id", "data_domain", "file_key", *known)
        done = done.unionByName(base.join(_whole(stage_blocks(others)), DOC, "left"))
    ext = S.file_extension(F.col("file_key"))
    return route(done, bucket, at, threshold).withColumns({
        "document_type": F.when(ext == ".pdf", "pdf").otherwise("image"),
        "forms": F.coalesce("forms", F.create_map().cast("map<string,string>")),
        "tables": F.coalesce("tables", F.array().cast("array<array<array<string>>>")),
    })


def certificate_header(docs: DataFrame) -> DataFrame:
    """(doc_id, field, value) of the known header fields that are filled, trailing colon dropped."""
    wanted = F.array(*[F.lit(f) for f in CERTIFICATE_FIELDS])
    return docs.select(DOC, "forms", F.explode(wanted).alias("name")).select(
        DOC, F.regexp_replace("name", ":", "").alias("field"),
        F.try_element_at("forms", F.col("name")).alias("value")).where(F.coalesce("value", F.lit("")) != "")


def certificate_view(docs: DataFrame) -> DataFrame:
    """Test results of the first table at least four columns wide: (doc_id, row_no, result, status).

    ``result`` maps header to cell; ``status`` is success, error or pending from the Status cell.
    """
    table = F.get(F.filter("tables", lambda t: F.size(F.get(t, F.lit(0))) >= 4), F.lit(0))
    rows = docs.select(DOC, F.get(table, F.lit(0)).alias("header"), F.posexplode(
        F.slice(table, 2, F.greatest(F.size(table), F.lit(1)))).alias("row_no", "cells"))
    names = F.array_distinct("header")
    values = F.transform(names, lambda h: F.coalesce(
        F.get("cells", (F.array_position("header", h) - 1).cast("int")), F.lit("")))
    result = F.map_from_arrays(names, values)
    verdict = F.try_element_at(result, F.lit("Status"))
    return rows.select(DOC, "row_no", result.alias("result"),
                       F.when(verdict == "PASS", "success").when(verdict == "FAIL", "error")
                       .otherwise("pending").alias("status"))
