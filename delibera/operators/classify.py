"""Classes of vectors and texts: surface features, scores over held-out folds, inference, crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delibera.runtime import cut

#: What the wording of an inference shows; each is a flag.
FLAGS = [
    r"\bwithout\b|\bunless\b|\bin the absence of\b|\babsent\b|\bcannot be (verified|assessed|determined|ruled|attributed|reproduced|evaluated|confirmed)\b|\bprevents?\b|\bhinders?\b",
    r"\bshould\b|\bmust\b|\brequires?\b|\brequired\b|\bneeds? to\b|\bexpected\b|\bprerequisite\b|\bnecessary\b|\bessential\b|\bstandards?\b|\bcriterion\b|\bbar\b",
    r"\bcould be\b|\bmay (be|reflect|stem|arise|indicate)\b|\bmight\b|\bartifact\b|\bconfound|\bmemoriz|\bleakage\b|\brather than\b|\binstead of\b|\bredundant\b",
    r"\bprior (work|art|methods)\b|\bexisting (work|methods|literature|approaches|solutions)\b|\bstate.of.the.art\b|\bsota\b|\bbaselines?\b|\bliterature\b|\bnovelty\b|\bcitations?\b|\bcompared? (to|with)\b",
    r"\bgeneraliz|\bbeyond\b|\bbroader\b|\bscope\b|\breal.world\b|\bunrealistic\b|\bapplicab|\btoy\b|\bnarrow\b|\blimited (scope|scale)\b|\bdomains?\b|\bsettings\b|\bscales?\b",
    r"\bpractical\b|\badoption\b|\bdeploy|\bcost\b|\boverhead\b|\bimpact\b|\butility\b|\befficien|\bfeasib",
    r"\bsufficient\b|\binsufficient\b|\bevidence\b|\bvalidate[sd]?\b|\bdemonstrate[sd]?\b|\bsupports?\b|\bresolve[sd]?\b|\baddress(es|ed)?\b|\bconfidence\b|\boutweigh|\bsignifican(t|ce)\b|\bconvincing\b|\bunresolved\b",
    r"\bclarity\b|\bclear\b|\bwell.written\b|\belegan|\bvaluable\b|\bimportant\b|\binteresting\b|\bstrength\b|\bweakness\b|\bflaw\b|\bpoor\b|\bcareless|\bprofessional",
]


def surface(text: Column) -> Column:
    """A flag for each of ``FLAGS``, and the words up to 60 as a share of 60."""
    t = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.array(*[t.rlike(f"(?i){p}").cast("double") for p in FLAGS], F.least(words, F.lit(60)) / 60)


def features(vector: Column, text: Column | None = None, weight: float = 0.5) -> Column:
    """The vector, followed by the weighted surface features of the text where there is one."""
    from pyspark.ml.functions import array_to_vector

    v = F.transform(vector, lambda x: x.cast("double"))
    return array_to_vector(v if text is None else F.concat(v, F.transform(surface(text), lambda x: x * weight)))


def _fit(train: DataFrame, c: float):
    from pyspark.ml.classification import LogisticRegression

    # the scale of a feature is its weight, so nothing is standardized
    return LogisticRegression(regParam=1 / (c * max(1, train.count())), maxIter=3000, standardization=False).fit(train)


def held_out(df: DataFrame, key: str, folds: int = 5, c: float = 8.0) -> DataFrame:
    """(key, fold, label, prediction) of each labelled row by a model of the other folds; folds by hash of the key."""
    e = df.where("label IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    parts = []
    for k in range(folds):
        parts.append(_fit(e.where(F.col("fold") != k), c).transform(e.where(F.col("fold") == k)).select(key, "fold", "label", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inferred(df: DataFrame, key: str, c: float = 8.0) -> DataFrame:
    """(key, label, prediction) of every row, labelled or not, by a model of all labelled rows."""
    return _fit(df.where("label IS NOT NULL"), c).transform(df).select(key, "label", "prediction")


def scores(pred: DataFrame) -> DataFrame:
    """Rows and F1 of each class, and accuracy and macro-F1 (class null), of each fold and of all (fold null)."""
    by = cut(pred.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("n")), "confusion")
    both = by.unionByName(by.withColumn("fold", F.lit(None).cast("int")))
    zero, hit = F.lit(0).cast("long"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0).cast("long"))
    sides = F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("s"), zero.alias("p"), hit.alias("t")), F.struct(F.col("prediction").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")))
    k = both.select("fold", F.explode(sides).alias("x")).groupBy("fold", F.col("x.class").cast("int").alias("class")).agg(F.sum("x.s").alias("n"), F.sum("x.p").alias("p"), F.sum("x.t").alias("t"))
    k = k.withColumn("f1", 2 * F.col("t") / (F.col("n") + F.col("p")))
    whole = k.groupBy("fold").agg(F.sum("n").alias("n"), F.round(F.sum("t") / F.sum("n"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("f1"))
    return k.select("fold", "class", "n", F.lit(None).cast("double").alias("accuracy"), F.round("f1", 4).alias("f1")).unionByName(whole.withColumn("class", F.lit(None).cast("int")))


def crosstab(pred: DataFrame, by: str) -> DataFrame:
    """Rows of each prediction and value of ``by``."""
    return pred.groupBy(by, "prediction").agg(F.count(F.lit(1)).alias("n"))
