"""Concordance lines, their frequencies, order and collocates."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import PARAGRAPH
from ..functions.keys import Fold, dict_key
from ..functions.text import norm_token
from ..session import remove, shared_folder

LINE = [*PARAGRAPH, "hit", "g_start"]
#: Places of a paragraph that are shuffled together.
STRETCH = 64


def token_nodes(matched: DataFrame) -> DataFrame:
    """Matched tokens as places of hits: a hit is a sentence."""
    return matched.select("doc_id", "para_pos", F.col("sent_pos").alias("hit"), "g")


def sequence_nodes(hits: DataFrame) -> DataFrame:
    """Places of the matches of a sequence search: a hit is a match, named by its first place."""
    return hits.select("doc_id", "para_pos", F.col("g").alias("hit"), F.explode("gs").alias("g"))


def runs(nodes: DataFrame) -> DataFrame:
    """Maximal contiguous runs of a hit's places (gaps and islands)."""
    by_hit = Window.partitionBy(*PARAGRAPH, "hit").orderBy("g")
    islands = nodes.distinct().withColumn("island", F.col("g") - F.row_number().over(by_hit))
    return islands.groupBy(*PARAGRAPH, "hit", "island").agg(F.min("g").alias("g_start"), F.max("g").alias("g_end")).drop("island")


def paragraph_arrays(tokens: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """A paragraph's tokens as one array in order: the paragraph is the widest context a line can have."""
    kept = F.struct("g", "form", "norm", "sent_pos", *extra)
    return tokens.groupBy(*PARAGRAPH).agg(F.array_sort(F.collect_list(kept)).alias("stream"))


def stretches(words: DataFrame) -> DataFrame:
    """Sentences with their words cut where the places of the paragraph reach a multiple of STRETCH: block, first place and words of each part."""
    end = F.col("g0") + F.size("words")
    blocks = F.sequence(F.floor(F.col("g0") / STRETCH), F.floor((end - 1) / STRETCH))
    rows = words.where(F.size("words") > 0).select(*PARAGRAPH, "sent_pos", "g0", "words", F.explode(blocks).alias("block"))
    first = F.greatest(F.col("g0"), F.col("block") * STRETCH).cast("int")
    return rows.select(*PARAGRAPH, "sent_pos", "block", first.alias("first"), F.slice("words", first - F.col("g0") + 1, F.lit(STRETCH) - F.pmod(first, F.lit(STRETCH))).alias("part"))


def windows(words: DataFrame, found: DataFrame, context: int) -> DataFrame:
    """The places of each run's window with their tokens, from sentences with their words: parts of sentences are shuffled, and only tokens of windows become rows."""
    low, high = F.greatest(F.col("g_start") - context, F.lit(0)).cast("int"), (F.col("g_end") + context).cast("int")
    runs_in = found.select("*", low.alias("low"), high.alias("high")).withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor(F.col("high") / STRETCH))))
    seen = runs_in.join(stretches(words), [*PARAGRAPH, "block"])
    skip = F.greatest(F.col("low") - F.col("first"), F.lit(0))
    cut = F.slice("part", skip + 1, F.greatest(F.col("high") - F.col("first") - skip + 1, F.lit(0)))
    seen = seen.select(*LINE, "g_end", "sent_pos", (F.col("first") + skip).alias("from"), F.posexplode(cut).alias("i", "form"))
    return seen.select(*LINE, "g_end", "sent_pos", (F.col("from") + F.col("i")).alias("g"), "form", norm_token(F.col("form")).alias("norm"))


def kwic(tokens: DataFrame, nodes: DataFrame, context: int = 12, full: bool = False, cap: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """A line for each run: left, node and right tokens, and whether the window crosses a sentence's edge.

    Each run is spread over the places of its window and joined with the tokens at these places, so a line costs its own
    width, whatever the paragraph's length. A full line is its whole paragraph by definition: there the paragraphs with a
    hit become arrays. words: the corpus' sentences with their words, if it has them; of these less is shuffled than of tokens.
    """
    found = runs(nodes)
    found = found if cap is None else found.orderBy(*LINE).limit(cap)
    start, end = F.col("g_start"), F.col("g_end")
    if full:
        window = found.join(paragraph_arrays(tokens.join(found.select(*PARAGRAPH).distinct(), PARAGRAPH, "left_semi")), PARAGRAPH).withColumnRenamed("stream", "window")
    else:
        if words is None:
            places = found.withColumn("g", F.explode(F.sequence(F.greatest(start - context, F.lit(0)), end + context)))
            seen = places.join(tokens.select(*PARAGRAPH, "g", "form", "norm", "sent_pos"), [*PARAGRAPH, "g"])
        else:
            seen = windows(words, found, context)
        window = seen.groupBy(*LINE, "g_end").agg(F.array_sort(F.collect_list(F.struct("g", "form", "norm", "sent_pos"))).alias("window"))
    part = lambda test: F.filter("window", test)
    lines = window.withColumns({"left": part(lambda t: t["g"] < start), "node": part(lambda t: t["g"].between(start, end)), "right": part(lambda t: t["g"] > end)})
    return lines.withColumn("crosses", F.size(F.array_distinct(F.transform("window", lambda t: t["sent_pos"]))) > 1).drop("window")


def surface(column: str, part: str = "form") -> Column:
    return F.array_join(F.transform(column, lambda t: t[part]), " ")


def flat(lines: DataFrame) -> DataFrame:
    """Lines with strings for their three parts."""
    return lines.select(*PARAGRAPH, "hit", "g_start", "g_end", surface("left").alias("left"), surface("node").alias("node"), surface("right").alias("right"), "crosses")


def freq_types(lines: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Node types by key, shown as first seen, the most frequent first."""
    rows = lines.select(*LINE, surface("node").alias("form"))
    types = rows.groupBy(dict_key(F.col("form"), fold).alias("key")).agg(F.count("*").alias("count"), F.min_by("form", F.struct(*LINE)).alias("form"))
    return types.select("key", "form", "count")


def ranked(types: DataFrame, k: int | None = None) -> DataFrame:
    """By count, then by form in the root collation, which doesn't hang on a host's locale."""
    out = types.orderBy(F.desc("count"), F.collate("form", "UNICODE"), "form")
    return out if k is None else out.limit(k)


def titles(paragraphs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, para_pos, document, section): titles for lines. Without one, a document or section goes by its number."""
    rows = paragraphs.select("doc_id", "para_pos", "sect_pos", "title")
    own = F.lit(None).cast("string")
    if documents is not None:
        rows, own = rows.join(documents.select("doc_id", F.col("title").alias("_own")), "doc_id", "left"), F.col("_own")
    document = F.coalesce(F.nullif(own, F.lit("")), F.format_string("Document %d", F.col("doc_id") + 1))
    section = F.coalesce(F.nullif("title", F.lit("")), F.format_string("Section %d", F.col("sect_pos") + 1))
    return rows.select("doc_id", "para_pos", document.alias("document"), section.alias("section"))


def distribution(lines: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """Lines (or runs) for each title; documents of one title merge. titles are of documents or of paragraphs. Ties keep the order of first lines."""
    rows = lines.select(*LINE).join(titles, [c for c in PARAGRAPH if c in titles.columns])
    return rows.groupBy(*by).agg(F.count("*").alias("count"), F.min(F.struct(*LINE)).alias("first")).drop("first")


def freq_total(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("total"))


def sort_key(anchor: str, fold: Fold = Fold()) -> Column:
    """The key of an anchor: node, L1.. or R1..; anything else is the same for all lines."""
    if anchor == "node":
        return dict_key(surface("node", "norm"), fold)
    m = re.fullmatch(r"([LR])(\d+)", anchor)
    if not m or not int(m[2]):
        return F.lit("")
    n = int(m[2])
    token = F.get("left", F.size("left") - n) if m[1] == "L" else F.get("right", F.lit(n - 1))
    return dict_key(F.coalesce(token["norm"], F.lit("")), fold)


def sort_kwic(lines: DataFrame, anchor: str, descending: bool = False, fold: Fold = Fold()) -> DataFrame:
    """Lines in the order of an anchor; ties keep corpus order in either direction."""
    if anchor == "corpus":
        return lines.orderBy(*LINE)
    lines = lines.withColumn("key", sort_key(anchor, fold))
    return lines.orderBy(F.desc("key") if descending else F.asc("key"), *LINE)


def ranked_lines(lines: DataFrame, key: str = "key") -> DataFrame:
    """Lines with their rank in the order of a key and then of the corpus: place in the sorted part, after all lines of earlier parts.

    Parts are ranges of key and place, so the lines of one key may fill several. They are written once, as a second sort
    could cut them elsewhere; the sizes summed in order are one row for each part.
    """
    spark = lines.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/ranked-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    # The number in front of the 33 bits that count rows is the part's.
    number = F.monotonically_increasing_id()
    lines.orderBy(key, *LINE).withColumns({"_part": F.shiftright(number, 33), "_own": number.bitwiseAND(F.lit((1 << 33) - 1)) + 1}).write.parquet(path)
    ordered = spark.read.parquet(path)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def collocates(tokens: DataFrame, nodes: DataFrame, window: int = 5, fold: Fold = Fold()) -> DataFrame:
    """Tokens within the window of each run, by key: how often, on which side, shown as first seen.

    Punctuation and the hit's own nodes don't count; a token in two windows counts twice. Each run is spread over its
    places, so the join is on equal places and not on a range.
    """
    found = runs(nodes)
    offsets = F.array(*(F.lit(i) for i in (*range(-window, 0), *range(1, window + 1))))
    around = found.select(*PARAGRAPH, "hit", "g_start", F.explode(offsets).alias("offset"), "g_end")
    around = around.withColumn("g", F.when(F.col("offset") < 0, F.col("g_start") + F.col("offset")).otherwise(F.col("g_end") + F.col("offset"))).where("g >= 0")
    around = around.join(nodes.distinct().select(*PARAGRAPH, "hit", "g"), [*PARAGRAPH, "hit", "g"], "left_anti")
    seen = around.join(tokens.where("norm <> ''").select(*PARAGRAPH, "g", "form", "norm"), [*PARAGRAPH, "g"])
    first = F.struct(*PARAGRAPH, "hit", "g_start", "offset")
    return seen.groupBy(dict_key(F.col("norm"), fold).alias("key")).agg(
        F.min_by("form", first).alias("form"), F.count("*").alias("count"), F.count_if(F.col("offset") < 0).alias("left"), F.count_if(F.col("offset") > 0).alias("right")
    )


def node_count(nodes: DataFrame) -> DataFrame:
    return runs(nodes).agg(F.count("*").alias("nodes"))


def neighbours(tokens: DataFrame) -> DataFrame:
    """The previous and next word in the document, across sentences and paragraphs, without punctuation."""
    order = Window.partitionBy("doc_id").orderBy("para_pos", "g")
    return tokens.where(~F.col("is_punct")).withColumns({"previous": F.lag("form").over(order), "next": F.lead("form").over(order)})


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """Counts of n consecutive word keys of a paragraph (beyond the usual reports)."""
    order = Window.partitionBy(*PARAGRAPH).orderBy("g")
    parts = [F.lead("form_key", i).over(order) if i else F.col("form_key") for i in range(n)]
    rows = tokens.where(~F.col("is_punct")).select(F.array(*parts).alias("parts"))
    return rows.where(F.get("parts", F.lit(n - 1)).isNotNull()).groupBy(F.array_join("parts", " ").alias("gram")).agg(F.count("*").alias("count"))
