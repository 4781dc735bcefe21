"""An index of forms: trigrams of the different forms, and places of each form as lists cut by documents.

A search asks the small tables first: a pattern's literal pieces give trigrams, forms that have them all are candidates,
the pattern decides, and only the lists of the forms it takes are read. A list holds the places of one form in DOCS documents, with doc_id as the
distance from the first of these, so the commonest word is many rows and no list grows with the corpus. It is stored as text, doc.para.sent.word
with a space between two, and read as it is or as an array.

Text is shuffled once, by paragraphs and before it is cut into words: all documents of a list then lie in one task, and a block's
lists are made over its arrays at once, morphemes from the block's different forms. Lists are sorted by form in small row groups of each
file, so that a scan skips those without a wanted form. A block has to fit a task some ten times over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import SENTENCE
from ..functions.keys import Fold, dict_key
from ..functions.text import tokenize
from .pattern import Token

#: Documents of one list, bytes of a row group, and forms that are named in a scan's filter; more are joined.
DOCS, ROW_GROUP, NAMED = 256, 4 << 20, 1_000
#: Stored bytes of text that one task makes lists of.
TASK = 16 << 20
GRAM = 3
KINDS = ["word", "morpheme"]
PLACE = ["doc", "para", "sent", "word"]
USES = "block long, kind int, forms array<string>, sizes array<int>, at array<int>, " + ", ".join(f"{p} array<int>" for p in PLACE)
LISTS = "kind string, form string, block long, n long, uses string"


@dataclass(frozen=True)
class FormIndex:
    forms: DataFrame
    grams: DataFrame
    lists: DataFrame


def _blocks(rows: DataFrame, kind: int = 0) -> DataFrame:
    """Rows of tokens, or of paragraphs with their sentences, with their block and the places of their first word."""
    one = F.col("sents") if "sents" in rows.columns else F.array(F.array("form"))
    first = [F.lit(0), F.lit(0)] if "sents" in rows.columns else [F.col("sent_pos").cast("int"), F.col("word_pos").cast("int")]
    block = F.floor(F.col("doc_id") / DOCS)
    return rows.select(block.alias("block"), F.lit(kind).alias("kind"), (F.col("doc_id") - block * DOCS).cast("int").alias("doc"), F.col("para_pos").cast("int").alias("para"), first[0].alias("sent"), first[1].alias("word"), one.alias("words"))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each of some sizes, one after the other."""
    return np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _uses(key: tuple, rows: pa.Table) -> pa.Table:
    """A block in one row: its different forms, how many uses each has, and the places of these by form; `at` numbers places in their order."""
    rows = rows.sort_by([(p, "ascending") for p in PLACE]).combine_chunks()
    number = lambda name: rows.column(name).to_numpy()
    sents = pa.concat_arrays(rows.column("words").chunks)
    words = sents.flatten()
    in_para, in_sent = (np.asarray(x.value_lengths(), np.int64) for x in (sents, words))
    of_sent = {"doc": np.repeat(number("doc"), in_para), "para": np.repeat(number("para"), in_para), "sent": np.repeat(number("sent"), in_para) + _within(in_para), "word": np.repeat(number("word"), in_para)}
    places = {p: np.repeat(v, in_sent) for p, v in of_sent.items()}
    places["word"] = places["word"] + _within(in_sent)
    coded = words.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    at = np.argsort(codes, kind="stable")
    whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    numbers = [np.bincount(codes, minlength=len(coded.dictionary)), at, *(places[p][at] for p in PLACE)]
    columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), whole(coded.dictionary), *(whole(pa.array(v.astype(np.int32))) for v in numbers)]
    return pa.Table.from_arrays(columns, ["block", "kind", "forms", "sizes", "at", *PLACE])


def _lists(block: int, kind: str, forms: pa.Array, sizes: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    some = np.flatnonzero(sizes)
    own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)), texts)
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), forms.take(pa.array(some)), pa.array([block] * n, pa.int64()), pa.array(sizes[some].astype(np.int64)), pc.binary_join(own, " ")], ["kind", "form", "block", "n", "uses"])


def _make_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of blocks: of their forms, and of morphemes, whose places are those of all forms that have them."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(name)[i].values  # noqa: B023, E731
            block, kind, forms, sizes, at = batch.column("block")[i].as_py(), KINDS[batch.column("kind")[i].as_py()], get("forms"), np.asarray(get("sizes")), np.asarray(get("at"))
            texts = pc.binary_join_element_wise(*(get(p).cast(pa.string()) for p in PLACE), ".")
            yield _lists(block, kind, forms, sizes, texts)
            parts = get("parts")
            if parts is None or not len(parts):
                continue
            of_form = np.asarray(parts.value_lengths().fill_null(0), np.int64)
            owner = np.repeat(np.arange(len(forms)), of_form)
            coded = parts.flatten().dictionary_encode()
            codes, n = np.asarray(coded.indices), sizes[owner]
            use = np.repeat((np.cumsum(sizes) - sizes)[owner], n) + _within(n)
            each = np.repeat(codes, n).astype(np.int64)
            order = np.argsort(each * (len(at) + 1) + at[use], kind="stable")
            yield _lists(block, "morpheme", coded.dictionary, np.bincount(each, minlength=len(coded.dictionary)), texts.take(pa.array(use[order])))


def build_index(tokens: DataFrame, path: str, fold: Fold = Fold(), morphemes: DataFrame | Callable[[Column], Column] | None = None) -> FormIndex:
    """Write the index of tokens below path, and, if given, of morphemes: rows (sentence keys, word_pos and form), or their array by a word's form.

    Instead of tokens, paragraphs with their sentences may be given (`sents`).
    """
    spark = tokens.sparkSession
    rows = _blocks(tokens)
    if isinstance(morphemes, DataFrame):
        rows = rows.withColumn("words", F.transform("words", tokenize) if "sents" in tokens.columns else F.col("words")).unionByName(_blocks(morphemes, 1))
    size = int(str(tokens._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if "sents" in tokens.columns and tokens.inputFiles() else 0  # the files' sizes
    tasks = [max(spark.sparkContext.defaultParallelism, size // TASK)] if size else []  # else the session's number
    rows = rows.repartition(*tasks, "block").sortWithinPartitions("block", "kind")
    if "sents" in tokens.columns and not isinstance(morphemes, DataFrame):
        rows = rows.withColumn("words", F.transform("words", tokenize))
    parts = morphemes if callable(morphemes) else lambda form: F.lit(None).cast("array<string>")
    uses = rows.groupBy("block", "kind").applyInArrow(_uses, USES).withColumn("parts", F.transform("forms", parts) if callable(morphemes) else F.lit(None).cast("array<array<string>>"))
    lists = uses.mapInArrow(_make_lists, LISTS).withColumn("form_key", dict_key(F.col("form"), fold))
    lists.sortWithinPartitions("form_key", "form", "kind", "block").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/lists")
    stored = spark.read.parquet(f"{path}/lists")
    forms = stored.groupBy("kind", "form").agg(F.sum("n").alias("n")).select("kind", dict_key(F.col("form"), fold).alias("form_key"), "form", "n")
    forms.sortWithinPartitions("form_key", "form").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/forms")
    forms = spark.read.parquet(f"{path}/forms")
    every = F.transform(F.sequence(F.lit(1), F.char_length("form_key") - (GRAM - 1)), lambda i: F.substring("form_key", i, F.lit(GRAM)))
    grams = forms.where(F.char_length("form_key") >= GRAM).select("form_key").distinct().select(F.explode(F.array_distinct(every)).alias("gram"), "form_key")
    grams.sortWithinPartitions("gram", "form_key").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/grams")
    return FormIndex(forms, spark.read.parquet(f"{path}/grams"), stored.withColumn("places", _as_places(F.col("uses"))))


def _as_places(uses: Column) -> Column:
    """A list's text as an array of places."""
    part = lambda p, i: F.split_part(p, F.lit("."), F.lit(i + 1)).cast("int")
    return F.transform(F.split(uses, " "), lambda p: F.struct(part(p, 0).alias("doc"), part(p, 1).alias("para_pos"), part(p, 2).alias("sent_pos"), part(p, 3).alias("word_pos")))


def pattern_grams(q: Token) -> list[set[str]] | None:
    """Trigrams that each of a folded pattern's variants asks for; None if a variant asks for none or starts with what it asks for."""
    if not q.folded:
        return None
    out = []
    for p in q.patterns:
        pieces = [re.sub(r"\\(.)", r"\1", x) for x in p[1:-2].split(".*")]
        found = {x[i : i + GRAM] for x in pieces for i in range(len(x) - GRAM + 1)}
        if not found or pieces[0]:  # a form's start is a range of the sorted tables
            return None
        out.append(found)
    return out


def matching_forms(index: FormIndex, q: Token, kind: str = "word") -> DataFrame:
    """The forms of a kind that a pattern takes."""
    forms = index.forms.where(F.col("kind") == kind)
    variants = pattern_grams(q)
    if variants:
        rows = index.grams.where(F.col("gram").isin(sorted(set().union(*variants))))
        full = [F.count_if(F.col("gram").isin(sorted(v))) == len(v) for v in variants]
        some = full[0]
        for test in full[1:]:
            some = some | test
        forms = forms.join(rows.groupBy("form_key").agg(some.alias("_may")).where("_may"), "form_key", "left_semi")
    return forms.where(q.matches(F.col("form"), F.col("form_key")))


def places(index: FormIndex, found: DataFrame, kind: str = "word") -> DataFrame:
    """(form, place) of each use of the forms found."""
    named = found.select("form_key", "form").limit(NAMED + 1).collect()  # NAMED forms at most are named
    lists = index.lists.where(F.col("kind") == kind)
    if len(named) <= NAMED:
        lists = lists.where(F.col("form_key").isin(sorted({r.form_key for r in named})) & F.col("form").isin(sorted({r.form for r in named})))
    else:
        lists = lists.join(found.select("form_key", "form"), ["form_key", "form"], "left_semi")
    rows = lists.select("form", "block", F.explode(F.split("uses", " ")).alias("p"))
    part = lambda i: F.split_part("p", F.lit("."), F.lit(i + 1)).cast("int")
    return rows.select("form", (F.col("block") * DOCS + part(0)).alias("doc_id"), *(part(i).alias(c) for i, c in ((1, "para_pos"), (2, "sent_pos"), (3, "word_pos"))))


def search_index(index: FormIndex, q: Token, kind: str = "word", cap: int | None = None) -> DataFrame:
    """The hits that a search of the token table gives, from the index alone."""
    rows = places(index, matching_forms(index, q, kind), kind)
    hits = rows.groupBy(*SENTENCE).agg(F.sort_array(F.collect_set("word_pos")).alias("words"))  # morphemes of one word may be several
    return hits if cap is None else hits.orderBy(*SENTENCE).limit(cap)
