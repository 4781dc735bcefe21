"""Standard lists that annotation draws on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in the order in which they are offered: parts of speech, types of entries, relations and templates of selection,
# universal dependency relations, and abbreviations of glosses.
LISTS = {
    "pos": "NOUN|PROPN|PRON|DEM|CLASS|CLF|QUANT|NUM|VERB|AUX|COP|ADJ|ADV|ADP|PREP|POSTP|PART|NEG|LINK|COORD|DET|INTJ|DISC|IDEO|SYM|PUNCT|AFFIX|UNK|PHRASE",
    "type": "word|bound.morpheme|phrase|functional.word|root|stem|interjection|symbol|punctuation",
    "selection_relation": "subject|direct object|indirect object|complement|argument|modification|adjunct|oblique|possessor|determination|quantification|case marking|linking",
    "selection_template": (
        "VERB:intransitive|VERB:transitive|VERB:ditransitive|VERB:clausal complement|VERB:adpositional argument|ADJ:attributive|ADJ:predicative|ADJ:adpositional complement|ADV:verb modifier|"
        "ADV:clause modifier|NOUN:clausal complement|NOUN:adpositional complement|NOUN:possessor|ADP:nominal complement|ADP:case marking|DET:determination|NUM:quantification|LINK:clause linking|"
        "COORD:coordination|AUX:verbal complement"
    ),
    "dep_relation": (
        "root|nsubj|obj|iobj|csubj|ccomp|xcomp|obl|vocative|expl|dislocated|advcl|advmod|discourse|aux|cop|mark|nmod|appos|nummod|acl|amod|det|clf|case|conj|cc|fixed|flat|compound|list|"
        "parataxis|orphan|goeswith|reparandum|punct|dep"
    ),
    "gloss": (
        "1|2|3|A|ABL|ABS|ACC|ADJ|ADV|AGR|ALL|ANTIP|APPL|AOR|ART|ASSOC|AUX|BEN|CAUS|CLF|CLT|COM|COMP|COMPL|COND|CONJ|CONT|COORD|COP|CVB|DAT|DECL|DEF|DEM|DET|DIM|DIR|DISJ|DIST|DISTR|DU|DUB|ERG|"
        "EVID|EXCL|EXIST|F|FEM|FOC|FUT|GEN|HAB|HON|HYP|IMP|INCL|IND|INDF|INF|INS|INT|IPFV|IRR|LNK|LOC|M|MASC|MID|MOD|N|NEUT|NEG|NMLZ|NOM|OBJ|OBL|OPT|ORD|P|PART|PASS|PFV|PL|POSS|PRED|PRF|PROG|"
        "PROH|PRON|PROX|PRS|PST|PTCP|PURP|Q|QUOT|RECP|REFL|REL|RELZ|RES|RPT|S|SBJ|SBJV|SEQ|SG|SPEC|STAT|TOP|TR|VOC"
    ),
}


def lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, i, v) for name, values in LISTS.items() for i, v in enumerate(values.split("|"))], "list string, place int, value string")
