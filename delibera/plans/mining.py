"""Text mining and vector queries: repeated texts, terms, frames, centroids, nearest neighbours, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import UNITS, cascade
from delibera.operators import classify as K
from delibera.operators import vectors as V
from delibera.plans import base
from delibera.runtime import cut, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '))"
STOP = ["the", "and", "for", "with", "that", "this", "are", "not", "its", "has"]


@query(f"WITH {UNITS}, r AS (SELECT {NORM.format('reasoning')} txt, unit_pk, forum_id FROM u WHERE reasoning IS NOT NULL), g AS (SELECT txt, count(*) n, count(DISTINCT forum_id) forums, min(unit_pk) first_pk, max(unit_pk) last_pk FROM r GROUP BY 1) SELECT * FROM g WHERE forums >= 2")
def g47_g48_repeated_texts(spark, d):
    """Reasonings that two forums share, as the SQL has it; g47_g48_field_texts has all fields, by review."""
    r = base.units(spark, d, "reasoning", "forum_id").where("reasoning IS NOT NULL").select(T.normalized(F.col("reasoning")).alias("txt"), "unit_pk", "forum_id")
    return r.groupBy("txt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("forum_id").alias("forums"), F.min("unit_pk").alias("first_pk"), F.max("unit_pk").alias("last_pk")).where("forums >= 2")


FIELDS = ["inspected_object", "observation", "reasoning", "judgment", "suggested_improvement"]
TEXTS = f"""{UNITS}, r AS (SELECT unit_pk, forum_id, reviewer_key, field, {NORM.format('t')} txt FROM (SELECT unit_pk, forum_id, reviewer_key, {', '.join(FIELDS)} FROM u) UNPIVOT (t FOR field IN ({', '.join(FIELDS)}))),
 g AS (SELECT field, txt, count(*) n, count(DISTINCT (forum_id, reviewer_key)) reviews, count(DISTINCT forum_id) forums, min(unit_pk) first_pk, max(unit_pk) last_pk FROM r WHERE txt <> '' GROUP BY 1, 2)"""


def _field_texts(spark, d):
    """(unit_pk, forum_id, reviewer_key, field, txt): every text field of every unit that isn't empty."""
    u = base.units(spark, d, "forum_id", "reviewer_key", *FIELDS)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), T.normalized(F.col(f)).alias("txt")) for f in FIELDS]))
    return u.select("unit_pk", "forum_id", "reviewer_key", pairs.alias("p")).select("unit_pk", "forum_id", "reviewer_key", "p.field", "p.txt").where("txt <> ''")


def _text_counts(r):
    review = F.struct("forum_id", "reviewer_key")
    return r.groupBy("field", "txt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(review).alias("reviews"), F.count_distinct("forum_id").alias("forums"), F.min("unit_pk").alias("first_pk"), F.max("unit_pk").alias("last_pk"))


@query(f"WITH {TEXTS} SELECT * FROM g WHERE reviews >= 2")
def g47_g48_field_texts(spark, d):
    """Texts of any field that two or more reviews share; a review is a reviewer of a forum."""
    return _text_counts(_field_texts(spark, d)).where("reviews >= 2")


@query(f"WITH {TEXTS} SELECT r.field, r.txt, r.forum_id, r.reviewer_key, r.unit_pk FROM r JOIN g ON g.field = r.field AND g.txt = r.txt WHERE g.reviews >= 2")
def g47_g48_text_places(spark, d):
    """Where the shared texts stand: a row for each unit, as a list of them has no bound."""
    r = _field_texts(spark, d)
    return r.join(_text_counts(r).where("reviews >= 2").select("field", "txt"), ["field", "txt"], "left_semi").select("field", "txt", "forum_id", "reviewer_key", "unit_pk")


@query(f"WITH {TEXTS} SELECT field, CAST(sum(n) AS BIGINT) instances, count(*) unique_texts, count(*) FILTER (reviews >= 2) reused_texts, max(reviews) most_reviews FROM g GROUP BY 1")
def g47_field_summary(spark, d):
    """Texts, distinct texts and shared texts of each field."""
    g = _text_counts(_field_texts(spark, d))
    return g.groupBy("field").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("unique_texts"), F.count_if(F.col("reviews") >= 2).alias("reused_texts"), F.max("reviews").alias("most_reviews"))


WORDS = "regexp_extract_all(lower(coalesce({0},'')), '[a-z0-9]+')"


@query(f"WITH {UNITS}, w AS (SELECT forum_id, {WORDS.format('reasoning')} w FROM u), s AS (SELECT DISTINCT forum_id, array_to_string(list_slice(w, i, i + 7), ' ') frame FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) i)) SELECT frame, count(*) owners FROM s GROUP BY 1 HAVING count(*) >= 4")
def g49_frames(spark, d):
    s = base.units(spark, d, "reasoning", "forum_id").select("forum_id", F.explode(T.shingles(F.col("reasoning"), 8)).alias("frame")).distinct()
    return s.groupBy("frame").agg(F.count(F.lit(1)).alias("owners")).where("owners >= 4")


TOK = f"SELECT unit_pk, year, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic, list_filter(list_distinct(regexp_extract_all(lower(coalesce(reasoning,'')), '[a-z][a-z\\-]{{2,}}')), lambda x: NOT list_contains({STOP}, x)) t FROM u"


@query(f"WITH {UNITS}, k AS ({TOK}), c AS (SELECT topic, unnest(t) term FROM k), tf AS (SELECT topic, term, count(*) tf FROM c GROUP BY ALL), n AS (SELECT topic, count(*) n FROM k GROUP BY 1), df AS (SELECT term, count(*) df FROM tf GROUP BY 1), s AS (SELECT topic, term, tf, df, round(tf / n * ln((SELECT count(*) FROM n) / (1 + df)), 6) score FROM tf JOIN n USING (topic) JOIN df USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) rn FROM s) SELECT topic, term, tf, df, score FROM r WHERE rn <= 8")
def m7_cluster_terms(spark, d):
    k = base.units(spark, d, "inspected_object", "reasoning").select(T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"), T.tokens(F.col("reasoning"), STOP).alias("t"))
    n = k.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    tf = k.select("topic", F.explode("t").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    score = F.round(F.col("tf") / F.col("n") * F.ln(F.lit(n.count()) / (1 + F.col("df"))), 6)
    s = tf.join(n, "topic").join(df, "term").select("topic", "term", "tf", "df", score.alias("score"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))).where("rn <= 8").drop("rn")


@query(f"WITH {UNITS}, k AS ({TOK}), e AS (SELECT CASE WHEN year <= 2022 THEN 'early' ELSE 'late' END era, unnest(t) term FROM k), c AS (SELECT era, term, count(*) n FROM e GROUP BY ALL), p AS (SELECT term, coalesce(max(n) FILTER (era = 'early'), 0) a, coalesce(max(n) FILTER (era = 'late'), 0) b FROM c GROUP BY 1 HAVING sum(n) > 20), z AS (SELECT sum(n) FILTER (era = 'early') na, sum(n) FILTER (era = 'late') nb FROM c) SELECT term, a, b, round(ln((b + 1) / (nb + 1)) - ln((a + 1) / (na + 1)), 6) log_odds FROM p, z")
def m8_era_terms(spark, d):
    k = base.units(spark, d, "year", "reasoning").select("year", F.explode(T.tokens(F.col("reasoning"), STOP)).alias("term"))
    c = k.groupBy("term").agg(F.count_if(F.col("year") <= 2022).alias("a"), F.count_if(F.col("year") > 2022).alias("b"))
    z = c.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return c.where(F.col("a") + F.col("b") > 20).select("term", "a", "b", F.round(F.ln((F.col("b") + 1) / (F.lit(z["b"]) + 1)) - F.ln((F.col("a") + 1) / (F.lit(z["a"]) + 1)), 6).alias("log_odds"))


@query(f"WITH {UNITS}, k AS ({TOK}), x AS (SELECT topic, unnest(t) term FROM k), c AS (SELECT topic, term, count(*) n FROM x GROUP BY ALL) SELECT topic, term, n FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) <= 3")
def g7_o5_top_terms(spark, d):
    k = base.units(spark, d, "inspected_object", "reasoning").select(T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"), F.explode(T.tokens(F.col("reasoning"), STOP)).alias("term"))
    c = k.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where("rn <= 3").drop("rn")


@query(f"WITH {UNITS}, k AS ({TOK}), a AS (SELECT topic, list_sort(list_distinct(flatten(list(t)))) v FROM k GROUP BY 1) SELECT x.topic a, y.topic b, len(list_intersect(x.v, y.v)) common, round(len(list_intersect(x.v, y.v)) / len(list_distinct(list_concat(x.v, y.v))), 6) jaccard FROM a x JOIN a y ON x.topic < y.topic")
def s4_j18_vocabulary_overlap(spark, d):
    k = base.units(spark, d, "inspected_object", "reasoning").select(T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"), F.explode(T.tokens(F.col("reasoning"), STOP)).alias("term")).distinct()
    size = k.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    common = k.select(F.col("topic").alias("a"), "term").join(k.select(F.col("topic").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    pairs = size.select(F.col("topic").alias("a"), F.col("n").alias("na")).join(size.select(F.col("topic").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0).cast("long")).alias("common"), F.round(F.coalesce("common", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("common", F.lit(0))), 6).alias("jaccard"))


CENT = """e AS (SELECT vec_id, label, unnest(embedding) x, generate_subscripts(embedding, 1) i FROM embeddings), mm AS (SELECT label, i, avg(CAST(x AS DOUBLE)) m FROM e GROUP BY ALL), nn AS (SELECT label, sqrt(sum(m * m)) z FROM mm GROUP BY 1), ce AS (SELECT label, i, m / z m FROM mm JOIN nn USING (label))"""


@query(f"WITH {CENT} SELECT label, CAST(i - 1 AS INT) i, round(m, 6) v FROM ce")
def m2_centroids(spark, d):
    c = V.centroids(read(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {CENT}, zz AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) z FROM e GROUP BY 1), dt AS (SELECT e.vec_id, ce.label, sum(CAST(e.x AS DOUBLE) * ce.m) / any_value(zz.z) s FROM e JOIN ce USING (i) JOIN zz ON zz.vec_id = e.vec_id GROUP BY ALL) SELECT vec_id, arg_max(label, s) nearest, round(max(s), 5) cos FROM dt GROUP BY 1")
def m3_j20_nearest_centroid(spark, d):
    e = read(spark, d, "embeddings")
    return V.nearest(e.select("vec_id", "embedding"), "embedding", V.centroids(e, "label", "embedding"), "label").select("vec_id", "nearest", F.round("cos", 5).alias("cos"))


@query(f"WITH {CENT}, dt AS (SELECT e.vec_id, e.label, sum(CAST(e.x AS DOUBLE) * ce.m) s FROM e JOIN ce ON ce.label = e.label AND ce.i = e.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, vec_id) rn FROM dt) SELECT label, vec_id, CAST(rn AS INT) rn FROM r WHERE rn <= 12")
def m16_g61_exemplars(spark, d):
    e = read(spark, d, "embeddings")
    c = V.centroids(e, "label", "embedding").select("label", "centroid")
    s = e.join(c, "label").select("label", "vec_id", F.round(V.dot(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).where("rn <= 12").select("label", "vec_id", F.col("rn").cast("int").alias("rn"))


@query(f"WITH {CENT}, dr AS (SELECT a.label, sum(a.m * b.m) s FROM ce a JOIN ce b ON b.label = a.label - 1 AND b.i = a.i GROUP BY 1) SELECT label, round(1 - s, 5) drift, round(median(1 - s) OVER (), 5) noise FROM dr")
def m9_w9_drift(spark, d):
    c = V.centroids(read(spark, d, "embeddings"), "label", "embedding")
    b = c.select((F.col("label") + 1).alias("label"), F.col("centroid").alias("_b"))
    j = c.join(b, "label").select("label", (1 - V.dot(F.col("centroid"), F.col("_b"))).alias("x"))
    m = j.agg(F.median("x").alias("m")).first()
    return j.select("label", F.round("x", 5).alias("drift"), F.round(F.lit(m["m"] if m else None), 5).alias("noise"))


@query("WITH p AS (SELECT vec_id, embedding[1] x, embedding[2] y FROM embeddings), b AS (SELECT min(x) ax, max(x) bx, min(y) ay, max(y) bys FROM p) SELECT vec_id, CAST(round_even((CAST(x AS DOUBLE) - ax) / (CAST(bx AS DOUBLE) - ax) * 4095, 0) AS INT) q_x, CAST(round_even((CAST(y AS DOUBLE) - ay) / (CAST(bys AS DOUBLE) - ay) * 4095, 0) AS INT) q_y FROM p, b")
def m14_grid(spark, d):
    p = read(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return V.grid_cells(p, ["x", "y"]).select("vec_id", "q_x", "q_y")


@query(None)
def m4_plane(spark, d):
    """The first two principal components, in place of a learned two-dimensional layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = read(spark, d, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", "label", vector_to_array("p").alias("p"))
    return p.select("vec_id", "label", F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"))


@query(None)
def m15_hulls(spark, d):
    """Regions of the plane of m4_plane by k-means: points, most frequent label, and the hull of the dense core."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = m4_plane(spark, d).withColumn("v", array_to_vector(F.array("x", "y")))
    model = KMeans(k=22, seed=7, featuresCol="v", predictionCol="region").fit(p)
    r = cut(model.transform(p).select("region", "vec_id", "label", "x", "y"), "regions")
    h = V.convex_hulls(V.dense_core(r, "region", "x", "y", "vec_id"), "region", "x", "y")
    return h.join(V.majority(r, "region", "label"), "region").select("region", "n", "label", "corner", "x", "y")


@query(None)
def m5_m6_kmeans_with_noise(spark, d):
    """k-means with the farthest twentieth of each cluster marked as noise (cluster -1)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = read(spark, d, "embeddings").select("vec_id", "embedding", array_to_vector("embedding").alias("v"))
    model = KMeans(k=8, seed=7, featuresCol="v", predictionCol="cluster").fit(e)
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    x = model.transform(e).join(F.broadcast(centers), "cluster")  # k rows
    x = x.withColumn("far", V.dot(F.zip_with("embedding", "c", lambda a, b: a - b), F.zip_with("embedding", "c", lambda a, b: a - b)))
    cut = x.groupBy("cluster").agg(F.percentile_approx("far", 0.95).alias("cut"))
    return x.join(F.broadcast(cut), "cluster").groupBy(F.when(F.col("far") > F.col("cut"), -1).otherwise(F.col("cluster")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, d):
    # no key ties a given vector to a text, so the surface features of a text can't be added here
    return read(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("label").cast("double").alias("label"), K.features(F.col("embedding")).alias("features"))


@query(None)
def m10_m12_classifier(spark, d):
    """Five folds by hash: accuracy, macro-F1 and the F1 of each class of a logistic regression over vectors alone."""
    return K.scores(K.held_out(_labelled(spark, d), "vec_id"))


@query(None)
def m12_predictions(spark, d):
    """The class of every vector by a model of all labelled ones."""
    p = K.inferred(_labelled(spark, d), "vec_id")
    return p.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query(None)
def m12_crosstab(spark, d):
    """Vectors of each label and predicted class."""
    return K.crosstab(m12_predictions(spark, d), "label")


@query(f"WITH {UNITS}, x AS (SELECT unit_pk, coalesce(MAP {{'experiment':'empirical','discussion':'talk'}}[split_part(coalesce(update_trigger,''), ' ', -1)], CASE WHEN length(update_trigger) > 12 THEN left(update_trigger, 9) || '...' ELSE coalesce(update_trigger, 'none') END) lbl FROM u) SELECT lbl, count(*) n FROM x GROUP BY 1")
def m13_label_merge(spark, d):
    m = F.create_map(F.lit("experiment"), F.lit("empirical"), F.lit("discussion"), F.lit("talk"))
    t = F.col("update_trigger")
    short = F.when(F.length(t) > 12, F.concat(F.substring(t, 1, 9), F.lit("..."))).otherwise(F.coalesce(t, F.lit("none")))
    lbl = F.coalesce(F.try_element_at(m, F.substring_index(F.coalesce(t, F.lit("")), " ", -1)), short)
    return base.units(spark, d, "update_trigger").groupBy(lbl.alias("lbl")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
