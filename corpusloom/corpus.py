"""A corpus as flat tables, keyed by position.

A document is sections between headings, a section is paragraphs between blank lines, a paragraph is sentences, a
sentence is tokens. All of that nests within the document's row, so segmentation shuffles nothing: a token's places among
all tokens of its paragraph and among those that aren't punctuation follow from the arrays.

`tokens` is what queries read: one row for each token. Stored are sentences with arrays of their words, a third of the
size; rows, keys and places follow from these in the scan, and only those that a query reads. `para_pos` runs over the whole document, `sect_para` starts anew in each section and is what ids
show. Ids are opaque; only positions sort. A document is one row's work, so it should fit a task's memory some ten times.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.ids import unit_id
from .functions.keys import Fold, detect_script, dict_key, fold_context
from .operators.ingest import sections_in_row
from .session import remove, shared_folder, ship

SENTENCE = ["doc_id", "para_pos", "sent_pos"]
PARAGRAPH = ["doc_id", "para_pos"]
#: What every unit carries of its document and section.
UNIT = ["doc_id", "lang", "source", "sect_pos", "sect_para", "para_pos"]
#: Bytes of a usual row group.
ROW_GROUP = 128 << 20
#: Stored bytes of text whose tokens one task groups.
TASK = 4 << 20
#: Documents, and characters of each, that tell a corpus's language and script.
SAMPLE_DOCS, SAMPLE_CHARS = 10, 400
_OPEN: dict[tuple[str, str], Corpus] = {}


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    sentences: DataFrame
    tokens: DataFrame | Callable[[], DataFrame]
    fold: Fold = field(default_factory=Fold)
    paragraphs: DataFrame | None = None
    folder: str | None = None

    def __post_init__(self):
        """Tokens may be given as a function that stores sentences with their words when either is first read."""
        if callable(self.tokens):
            object.__setattr__(self, "_later", self.tokens)
            object.__delattr__(self, "tokens")

    def __getattr__(self, name: str):
        if name not in ("tokens", "words") or "_later" not in self.__dict__:
            raise AttributeError(name)
        made = self._later()
        rows = "words" in made.columns
        object.__setattr__(self, "words", made if rows else None)
        object.__setattr__(self, "tokens", flat_tokens(made, self.fold) if rows else made)
        return self.__dict__[name]

    def in_sentences(self) -> DataFrame:
        """Sentences with an array of their words: those stored, if a query of the session stored them, or made in the scan."""
        stored = self.__dict__.get("words")
        if stored is not None or self.paragraphs is None:
            return stored if stored is not None else self.words
        # A generator's output: a filter on the words isn't moved below it, where it would make them a second time.
        return self.paragraphs.select(*UNIT, F.posexplode(F.transform("sents", T.tokenize)).alias("sent_pos", "words"))

    def in_paragraphs(self) -> DataFrame:
        """Tokens with their place g in the paragraph and no other: from what is stored, or made in the scan. For queries that read them once and no sentences."""
        stored = self.__dict__.get("words")
        if stored is not None:
            rows = stored.select(*UNIT, "g0", F.posexplode("words").alias("p", "form")).select(*UNIT, (F.col("g0") + F.col("p")).alias("g"), "form")
        elif self.paragraphs is not None:
            rows = self.paragraphs.select(*UNIT, F.posexplode(F.flatten(F.transform("sents", T.tokenize))).alias("g", "form"))
        else:
            rows = self.tokens.select(*UNIT, "g", "form")
        return rows.withColumns({"is_punct": T.is_punct(F.col("form")), "form_key": dict_key(F.col("form"), self.fold)})

    def tokens_by_paragraph(self) -> DataFrame:
        """Tokens for queries that group them by sentence: text is shuffled by paragraphs before it is cut into words, so that no token is, and words are not stored."""
        if self.paragraphs is None or not self.paragraphs.inputFiles():
            return self.tokens
        size = int(str(self.paragraphs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files
        tasks = max(self.paragraphs.sparkSession.sparkContext.defaultParallelism, size // TASK)
        return tokens(self.paragraphs.repartition(tasks, *PARAGRAPH), self.fold)


def paragraphs(documents: DataFrame, text: Column | None = None) -> DataFrame:
    """Paragraphs of the normalised text: their section and its title, and their places in it and in the document."""
    own = text if text is not None else F.col("text")
    # Nulls go by the raw text: a filter on the normalised one would work it out twice.
    normal = documents.where(own.isNotNull()).select("doc_id", "lang", "source", T.normalize_text(own).alias("text"))
    one = lambda s, i, p, j: F.struct(i.alias("sect_pos"), s["title"].alias("title"), j.alias("sect_para"), p.alias("para"))
    nested = F.flatten(F.transform("sections", lambda s, i: F.transform(T.split_paragraphs(s["body"]), lambda p, j: one(s, i, p, j))))
    rows = sections_in_row(normal).select("doc_id", "lang", "source", F.posexplode(nested).alias("para_pos", "p"))
    return rows.select("doc_id", "lang", "source", "p.sect_pos", "p.title", "p.sect_para", "para_pos", "p.para")


def segmented(paras: DataFrame) -> DataFrame:
    """Paragraphs with an array of their sentences, from which sentences and tokens follow."""
    return paras.select(*UNIT, "title", T.split_sentences(F.col("para")).alias("sents"))


def sentences(paras: DataFrame) -> DataFrame:
    rows = paras if "sents" in paras.columns else segmented(paras)
    return rows.select(*UNIT, F.posexplode("sents").alias("sent_pos", "sentence"))


def _starts(sizes: Column, width: int) -> Column:
    """Where each sentence's words start, from an array that holds each sentence's number once for each word and `width` times more."""
    return F.filter(F.transform(sizes, lambda s, k: F.when((k == 0) | (F.get(sizes, k - 1) != s), k - s * width).otherwise(F.lit(-1))), lambda k: k >= 0)


def worded(paras: DataFrame) -> DataFrame:
    """A row for each sentence: its words as an array, the places of those that aren't punctuation, and how many of either go before it in the paragraph.

    In time proportional to the text: a sentence's number is repeated once for each of its words and once more, and a sum ends where it changes.
    """
    rows = paras if "sents" in paras.columns else segmented(paras)
    rows = rows.select(*UNIT, F.transform("sents", T.tokenize).alias("words"))
    places = lambda w: F.filter(F.transform(w, lambda x, j: F.when(T.is_punct(x), F.lit(-1)).otherwise(j)), lambda j: j >= 0)
    rows = rows.select(*UNIT, "words", F.transform("words", places).alias("content"))
    repeated = lambda c: F.flatten(F.transform(c, lambda w, i: F.array_repeat(i, F.size(w) + 1)))
    rows = rows.select("*", repeated("words").alias("gs"), repeated("content").alias("cs"))
    rows = rows.select(*UNIT, "words", "content", _starts(F.col("gs"), 1).alias("g0"), _starts(F.col("cs"), 1).alias("c0"))
    one = F.transform("words", lambda w, i: F.struct(w.alias("words"), F.get("content", i).alias("content"), F.get("g0", i).alias("g0"), F.get("c0", i).alias("c0")))
    return rows.select(*UNIT, F.posexplode(one).alias("sent_pos", "s")).select(*UNIT, "sent_pos", "s.*")


def flat_tokens(rows: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Tokens of sentences with their words; what a query doesn't read isn't worked out."""
    stop = lambda k: F.coalesce(F.get("content", k + 1), F.size("words"))
    ranks = F.concat(F.array_repeat(F.lit(-1), F.coalesce(F.get("content", F.lit(0)), F.lit(0))), F.flatten(F.transform("content", lambda p, k: F.array_repeat(k, stop(k) - p))))
    rows = rows.select(*UNIT, "sent_pos", "words", "g0", "c0", ranks.alias("ranks"), F.size("content").alias("n"))
    rows = rows.select(*UNIT, "sent_pos", "g0", "c0", "ranks", "n", F.posexplode("words").alias("word_pos", "form"))
    rank, punct = F.get("ranks", F.col("word_pos")), T.is_punct(F.col("form"))
    rows = rows.select(*UNIT, "sent_pos", "word_pos", "form", punct.alias("is_punct"), (F.col("g0") + F.col("word_pos")).alias("g"), "c0", rank.alias("rank"), "n")
    own = ~F.col("is_punct")
    rows = rows.select(*UNIT, "sent_pos", "word_pos", "form", "is_punct", "g", F.when(own, F.col("c0") + F.col("rank")).alias("c"), (own & (F.col("rank") == 0)).alias("is_first"), (own & (F.col("rank") == F.col("n") - 1)).alias("is_last"))
    return rows.withColumns({"form_key": dict_key(F.col("form"), fold), "norm": T.norm_token(F.col("form"))})


def tokens(paras: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """Tokens of paragraphs: their places, keys, and whether they are punctuation.

    word_pos: in the sentence. g: among all tokens of the paragraph. c: among those that aren't punctuation; is_first and
    is_last tell whether one of these is at its sentence's edge.
    """
    return flat_tokens(worded(paras), fold)


def word_id(sent: bool = False) -> Column:
    return unit_id(F.col("doc_id"), F.col("sect_pos"), F.col("sect_para"), F.col("sent_pos"), None if sent else F.col("word_pos"))


def derive_fold(documents: DataFrame) -> Fold:
    """How a corpus compares forms: its language, if the first documents agree on one, and the script of their texts."""
    first = documents.where(F.trim(F.coalesce("text", F.lit(""))) != "").orderBy("doc_id").select("lang", F.left("text", F.lit(SAMPLE_CHARS)).alias("head")).limit(SAMPLE_DOCS)
    found = first.agg(F.when(F.count_distinct("lang") == 1, F.min("lang")).alias("lang"), detect_script(F.array_join(F.collect_list("head"), " ")).alias("script")).first()
    return fold_context(found.lang, found.script)


def spread(documents: DataFrame) -> DataFrame:
    """A small input may be one row group, that is one task: its rows are dealt to all cores. A larger one is read as it is."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return documents.repartition(cores) if size < cores * ROW_GROUP else documents


def build(documents: DataFrame, path: str, fold: Fold | None = None, folder: str | None = None) -> Corpus:
    """Segment documents into tables below path: paragraphs with their sentences and, once a query reads tokens, sentences with their words."""
    spark = documents.sparkSession
    fold = fold or derive_fold(documents)
    segmented(paragraphs(spread(documents))).write.parquet(f"{path}/paragraphs")
    paras = spark.read.parquet(f"{path}/paragraphs")

    def later() -> DataFrame:
        worded(paras).write.parquet(f"{path}/words")
        return spark.read.parquet(f"{path}/words")

    return Corpus(documents, sentences(paras), later, fold, paras, folder)


def open_corpus(spark: SparkSession, sf_dir: str, fold: Fold | None = None) -> Corpus:
    """The corpus in sf_dir, segmented once for a session into tables in the shared folder."""
    ship(spark)
    key = (spark.sparkContext.applicationId, f"{sf_dir} {fold}")
    if key not in _OPEN:
        path = f"{shared_folder(spark)}/corpusloom/corpus-{uuid.uuid4().hex[:12]}"
        atexit.register(remove, spark, path)
        _OPEN[key] = build(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, fold, sf_dir)
    return _OPEN[key]
