"""Names and codes of languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import fold_diacritics

# Code, English name, own name, ISO 639-3, translation code of each language.
LANGUAGES = """
af Afrikaans Afrikaans afr afr_Latn
ar Arabic العربية ara arb_Arab
be Belarusian беларуская bel bel_Cyrl
bg Bulgarian Български bul bul_Cyrl
bxr Buryat Буряад bxr -
ca Catalan Català cat cat_Latn
cop Coptic ⲙⲉⲧⲣⲉⲙⲛⲕⲏⲙⲉ cop -
cs Czech Čeština ces ces_Latn
cu Old_Church_Slavonic словѣньскъ chu -
cy Welsh Cymraeg cym cym_Latn
da Danish Dansk dan dan_Latn
de German Deutsch deu deu_Latn
el Greek Ελληνικά ell ell_Grek
en English English eng eng_Latn
es Spanish Español spa spa_Latn
et Estonian Eesti est est_Latn
eu Basque Euskara eus eus_Latn
fa Persian فارسی fas pes_Arab
fi Finnish Suomi fin fin_Latn
fr French Français fra fra_Latn
fro Old_French François fro -
ga Irish Gaeilge gle gle_Latn
gl Galician Galego glg glg_Latn
got Gothic 𐌲𐌿𐍄𐌹𐍃𐌺 got -
grc Ancient_Greek Ἀρχαία_ἑλληνική grc -
he Hebrew עברית heb heb_Hebr
hi Hindi हिन्दी hin hin_Deva
hr Croatian Hrvatski hrv hrv_Latn
hsb Upper_Sorbian Hornjoserbsce hsb -
hu Hungarian Magyar hun hun_Latn
hy Armenian Հայերեն hye hye_Armn
id Indonesian Indonesia ind ind_Latn
it Italian Italiano ita ita_Latn
ja Japanese 日本語 jpn jpn_Jpan
ko Korean 한국어 kor kor_Hang
la Latin Latina lat -
lij Ligurian Ligure lij -
lt Lithuanian Lietuvių lit lit_Latn
lv Latvian Latviešu lav lvs_Latn
mdf Moksha Мокшень mdf -
mr Marathi मराठी mar mar_Deva
mt Maltese Malti mlt mlt_Latn
myv Erzya Эрзянь myv -
nl Dutch Nederlands nld nld_Latn
nn Norwegian_Nynorsk Nynorsk nno nno_Latn
no Norwegian_Bokmål Bokmål nob nob_Latn
olo Livvi-Karelian Livvin_karjala olo -
orv Old_Russian Словѣньскъ orv -
pl Polish Polski pol pol_Latn
pt Portuguese Português por por_Latn
ro Romanian Română ron ron_Latn
ru Russian Русский rus rus_Cyrl
sk Slovak Slovenčina slk slk_Latn
sl Slovenian Slovenščina slv slv_Latn
sme Northern_Sami Davvisámegiella sme -
sq Albanian Shqip sqi als_Latn
sr Serbian Српски srp srp_Cyrl
su Sundanese Basa_Sunda sun sun_Latn
sv Swedish Svenska swe swe_Latn
swl Swedish_Sign_Language Svenskt_teckenspråk swl -
ta Tamil தமிழ் tam tam_Taml
te Telugu తెలుగు tel tel_Telu
th Thai ไทย tha tha_Thai
tr Turkish Türkçe tur tur_Latn
ug Uyghur ئۇيغۇرچە uig uig_Arab
uk Ukrainian Українська ukr ukr_Cyrl
ur Urdu اردو urd urd_Arab
vi Vietnamese Tiếng_Việt vie vie_Latn
wo Wolof Wolof wol wol_Latn
zh-hans Simplified_Chinese 简体中文 zho zho_Hans
zh-hant Traditional_Chinese 繁體中文 - zho_Hant
"""


def languages(spark: SparkSession) -> DataFrame:
    rows = [line.split() for line in LANGUAGES.strip().splitlines()]
    return spark.createDataFrame([(c, e.replace("_", " "), o.replace("_", " "), None if i == "-" else i, None if t == "-" else t) for c, e, o, i, t in rows], "code string, english_name string, native_name string, iso639_3 string, translation_code string")


def aliases(spark: SparkSession) -> DataFrame:
    return languages(spark).select("code", "english_name", "translation_code", F.explode(F.array_distinct(F.array_compact(F.array("code", "english_name", "native_name", "iso639_3")))).alias("alias"))


def resolve_language(names: DataFrame, column: str) -> DataFrame:
    """Canonical code of a name, code or alias, whatever its case; null if there is none."""
    known = aliases(names.sparkSession).select(F.lower("alias").alias("_alias"), "code", "translation_code").dropDuplicates(["_alias"])
    return names.join(F.broadcast(known), F.lower(F.trim(F.col(column))) == F.col("_alias"), "left").drop("_alias")


def suggest_language(names: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k likeliest languages of a misspelt name: equal but for accents, prefix, part, few edits; the alias table is small and fixed."""
    known = aliases(names.sparkSession).withColumn("_a", fold_diacritics(F.col("alias")))
    asked = names.select(column).distinct().withColumn("_q", fold_diacritics(F.trim(F.col(column))))
    pairs = asked.join(F.broadcast(known), F.lit(True))
    q, a = F.col("_q"), F.col("_a")
    n, m = F.char_length(q), F.char_length(a)
    edits = F.levenshtein(q, a)
    score = (
        F.when(q == a, 0)
        .when((n >= 2) & a.startswith(q), 1)
        .when((n >= 4) & a.contains(q), 2)
        .when((F.abs(n - m) <= 3) & (edits <= F.when(n <= 4, 1).otherwise(2)), edits + 3)
    )
    scored = pairs.withColumn("score", score).where("score is not null")
    best = Window.partitionBy(column, "code").orderBy("score", F.char_length("alias"), "alias")
    first = Window.partitionBy(column).orderBy("score", F.char_length("alias"), "alias", "code")
    one = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return one.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(column, "rank", "code", "alias", "score")
