"""The common-word half of the quality rules."""

import re
from collections import Counter

from pyspark.sql import functions as F

from kilnflow.llm import quality_rules


def test_each_common_word_is_counted(spark):
    texts = {"en": "The of the, and THE with of x", "de": "und und der haus mit", "fr": "pour pour pour", "xx": "the of"}
    df = spark.createDataFrame([(i, la, t) for i, (la, t) in enumerate(texts.items())], "doc_id long, lang string, text string")
    for r in quality_rules.features(df).collect():
        want = Counter(re.findall(r"\w+", texts[r.lang].lower()))
        assert [r[f"w{j}"] for j in range(12)] == [want[w] for w in quality_rules.COMMON[r.lang]] if r.lang != "xx" else not any(r[f"w{j}"] for j in range(12))


def test_a_text_of_the_wrong_language_goes_by_its_words_alone(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    foreign = documents.join(labels, "doc_id").filter("lang <> 'en' and size(split(text, ' ')) between 200 and 2000")
    planted = foreign.dropDuplicates(["lang"]).withColumn("doc_id", F.col("doc_id") + 7_000_000).withColumn("lang", F.lit("en"))
    rows = quality_rules.judge(documents.unionByName(planted.select(*documents.columns))).filter("doc_id >= 7000000").collect()
    assert rows and not any(r.base_failed or r.class_distance > quality_rules.MAX_CLASS for r in rows)
    assert not any(r.kept for r in rows)
