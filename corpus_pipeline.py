"""A corpus pipeline: documents in, training tokens out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each
stage's result to the shared folder and reads it back. Every column of documents goes along until the last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import bpe, decontaminate, jaccard, secrets, toxicity
from codeloom.llm.common import carried, scratch, table


def drop_toxic(spark, docs, sf_dir):
    """Documents scored below the threshold by a network fitted on labelled documents.

    Null, empty and wordless texts score 0 and stay; repeated rows are judged alike; labels of one class, or none,
    give a constant score; an empty table stays empty; other columns go along whatever their names.
    """
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    renamed, names, back = carried(docs)
    return back(toxicity.score(renamed, net, keep=names).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null, empty and wordless texts are near nothing and stay, but for rows that repeat both doc_id and text, of which one stays.
    Rows without a doc_id come after all others. An empty table stays empty; other columns go along whatever their names.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents of which less than a twentieth of the words lies in benchmark windows, or none.

    Null and wordless texts stay; repeated rows are judged each; benchmark items without an id or words count for
    nothing, and an empty benchmark keeps all; an empty table stays empty; other columns go along whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """All documents, secrets replaced in text, n_chars counted anew where one was.

    Null and empty texts stay as they are, repeated rows are redacted each, an empty table stays empty, and other columns go along.
    """
    return secrets.redact(docs)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, tokens and the digest of the text decoded from them, a row for each document.

    Null counts as empty, which has no tokens; repeated rows are encoded each; an empty table stays empty; other columns are ignored.
    """
    return bpe.tokenized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]

#: SQL can't express a trained network; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
