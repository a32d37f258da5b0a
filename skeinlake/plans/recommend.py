"""Queries of recommendations: six factors, their weighted sum, diversity, reasons; remedial content, best chunks, paths for levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import neighbours, ranks
from ..operators.lineage import cut
from ..operators.recommend import WEIGHTS, diverse, reasons, six, weighted
from .learners import _MASTERY_SQL, _mastery
from .projection import LEARNER_EVENTS_SQL, PREREQUISITES_SQL, learner_events, prerequisites, read
from .registry import query

#: A chunk stands for each concept: its vector is that of the same number.
_PROFILE_SQL = f"""{LEARNER_EVENTS_SQL}, {PREREQUISITES_SQL}, rated AS (SELECT student_id, concept_id, avg(score) AS rating, max(ts) AS last FROM learner_events WHERE score IS NOT NULL GROUP BY 1, 2), level AS (SELECT student_id, avg(rating) AS level FROM rated GROUP BY 1), now AS (SELECT max(last) AS as_of FROM rated),
vec AS (SELECT vec_id AS concept_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ud AS (SELECT student_id, unnest(e) AS x, unnest(range(len(e))) AS dim FROM rated JOIN vec USING (concept_id) WHERE rating >= 0.6), um AS (SELECT student_id, dim, avg(x) AS x FROM ud GROUP BY 1, 2), interest AS (SELECT student_id, list(x ORDER BY dim) AS i FROM um GROUP BY 1)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner_events(spark, sf_dir).where("score IS NOT NULL").groupBy("student_id", "concept_id").agg(F.avg("score").alias("rating"), F.max("ts").alias("last"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten learners most like each one by the cosine of their ratings."""
    return neighbours.most_alike(_rated(spark, sf_dir), "student_id", "concept_id", "rating", 10)


_SIMILAR_SQL = """norms AS (SELECT student_id, sqrt(sum(rating * rating)) AS norm FROM rated GROUP BY 1), dots AS (SELECT a.student_id, b.student_id AS other, sum(a.rating * b.rating) AS dot FROM rated a JOIN rated b ON a.concept_id = b.concept_id AND a.student_id <> b.student_id GROUP BY 1, 2),
sim0 AS (SELECT d.student_id, other, round(dot / nullif(x.norm * y.norm, 0), 6) AS similarity FROM dots d JOIN norms x ON x.student_id = d.student_id JOIN norms y ON y.student_id = other WHERE round(dot / nullif(x.norm * y.norm, 0), 6) > 0), sim AS (SELECT student_id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY similarity DESC, other) AS place FROM sim0) WHERE place <= 10)"""


@query(f"WITH {_PROFILE_SQL}, {_SIMILAR_SQL} SELECT student_id, other, round(similarity + 1e-9, 5) AS similarity FROM sim")
def similar_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).withColumn("similarity", F.round(F.col("similarity") + 1e-9, 5))


#: Candidates of a learner in all; of each of the first three sources a third at most, of exploration a quarter.
CANDIDATES = 40
#: Topics of a learner whose concepts are candidates, and of whom one in five explores.
TOPICS, EXPLORING = 2, 858_993_459

_CANDIDATES_SQL = f"""quality AS (SELECT concept_id, concept_id % 6 AS topic, round(avg(rating), 6) AS q FROM rated GROUP BY 1),
topics AS (SELECT student_id, concept_id % 6 AS topic, row_number() OVER (PARTITION BY student_id ORDER BY round(avg(rating), 6) DESC, concept_id % 6) AS nth FROM rated GROUP BY student_id, concept_id % 6),
best AS (SELECT concept_id, topic, row_number() OVER (PARTITION BY topic ORDER BY q DESC, concept_id) AS nth FROM quality),
c1 AS (SELECT student_id, concept_id, row_number() OVER (PARTITION BY student_id ORDER BY b.nth, t.nth) AS place FROM topics t JOIN best b ON b.topic = t.topic WHERE t.nth <= {TOPICS}),
c2 AS (SELECT r.student_id, p.src AS concept_id, row_number() OVER (PARTITION BY r.student_id ORDER BY count(*) DESC, p.src) AS place FROM rated r JOIN prerequisites p ON p.dst = r.concept_id
  WHERE r.rating >= 0.7 AND NOT EXISTS (SELECT 1 FROM rated x WHERE x.student_id = r.student_id AND x.concept_id = p.src AND x.rating >= 0.7) GROUP BY 1, 2),
c3 AS (SELECT sim.student_id, r.concept_id, row_number() OVER (PARTITION BY sim.student_id ORDER BY count(*) DESC, r.concept_id) AS place FROM sim JOIN rated r ON r.student_id = other WHERE r.rating > 0.7 GROUP BY 1, 2),
good AS (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS i, count(*) OVER () AS n FROM quality WHERE q >= 0.5),
c4 AS (SELECT student_id, concept_id, min(j) + 1 AS place FROM level, range(0, {CANDIDATES // 4}) t(j), good WHERE student_id * 2654435761 % 4294967296 < {EXPLORING} AND i = (student_id * 7919 + j * 104729) % n GROUP BY 1, 2),
sources AS (SELECT student_id, concept_id, 1 AS source, place FROM c1 WHERE place <= {CANDIDATES // 3} UNION ALL SELECT student_id, concept_id, 2, place FROM c2 WHERE place <= {CANDIDATES // 3} UNION ALL SELECT student_id, concept_id, 3, place FROM c3 WHERE place <= {CANDIDATES // 3} UNION ALL SELECT student_id, concept_id, 4, place FROM c4),
cand AS (SELECT student_id, concept_id, source FROM (SELECT student_id, concept_id, min(source) AS source, row_number() OVER (PARTITION BY student_id ORDER BY min(source * 1000 + place), concept_id) AS nth FROM sources GROUP BY 1, 2) WHERE nth <= {CANDIDATES})"""


def _first(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first rows of each key, numbered in `place`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def _candidates(spark: SparkSession, sf_dir: str, rated: DataFrame, similar: DataFrame) -> DataFrame:
    """student_id, concept_id, source: 1 of topics that a learner rates best, 2 next in the paths, 3 liked by similar learners, 4 exploration.

    Exploration takes concepts by a rule on the learner's number from all that are rated well, so that it is the same each time.
    """
    third = CANDIDATES // 3
    topic = (F.col("concept_id") % 6).alias("topic")
    quality = cut(rated.groupBy("concept_id").agg(six(F.avg("rating")).alias("q")).withColumn("topic", topic))
    topics = _first(rated.groupBy("student_id", topic).agg(six(F.avg("rating")).alias("q")), "student_id", [F.desc("q"), "topic"], TOPICS)
    best = _first(quality, "topic", [F.desc("q"), "concept_id"], third).select("topic", "concept_id", F.col("place").alias("nth"))
    of_topics = _first(topics.select("student_id", "topic", F.col("place").alias("t")).join(best, "topic"), "student_id", ["nth", "t"], third)
    known = rated.where("rating >= 0.7").select("student_id", "concept_id")
    next_ones = known.join(prerequisites(spark, sf_dir).select(F.col("dst").alias("concept_id"), "src"), "concept_id").groupBy("student_id", F.col("src").alias("concept_id")).agg(F.count("*").alias("n"))
    next_ones = _first(next_ones.join(known, ["student_id", "concept_id"], "left_anti"), "student_id", [F.desc("n"), "concept_id"], third)
    liked = similar.join(rated.where("rating > 0.7").select(F.col("student_id").alias("other"), "concept_id"), "other").groupBy("student_id", "concept_id").agg(F.count("*").alias("n"))
    liked = _first(liked, "student_id", [F.desc("n"), "concept_id"], third)
    good = ranks.numbered(quality.where("q >= 0.5").select("concept_id"), "concept_id", "i")
    size = good.agg(F.count("*").alias("n"))  # one row
    explorers = rated.select("student_id").distinct().where(F.col("student_id") * 2654435761 % 4294967296 < EXPLORING)
    drawn = explorers.join(F.broadcast(size)).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CANDIDATES // 4 - 1).cast("long"))))
    drawn = drawn.withColumn("i", (F.col("student_id") * 7919 + F.col("j") * 104729) % F.col("n") + 1).join(good, "i").groupBy("student_id", "concept_id").agg((F.min("j") + 1).alias("place"))
    every = None
    for source, rows in enumerate((of_topics, next_ones, liked, drawn), 1):
        part = rows.select("student_id", F.col("concept_id").cast("long").alias("concept_id"), F.lit(source).alias("source"), F.col("place").cast("long").alias("place"))
        every = part if every is None else every.unionByName(part)
    rows = every.groupBy("student_id", "concept_id").agg(F.min("source").alias("source"), F.min(F.col("source") * 1000 + F.col("place")).alias("order"))
    return _first(rows, "student_id", ["order", "concept_id"], CANDIDATES).select("student_id", "concept_id", "source")


@query(f"WITH {_PROFILE_SQL}, {_SIMILAR_SQL}, {_CANDIDATES_SQL} SELECT student_id, concept_id, CASE source WHEN 1 THEN 'interest' WHEN 2 THEN 'path' WHEN 3 THEN 'popular' ELSE 'exploration' END AS source FROM cand")
def recommendation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner may be recommended, and the first of the four sources that names it."""
    names = F.array(*(F.lit(x) for x in ("interest", "path", "popular", "exploration")))
    rows = _candidates(spark, sf_dir, cut(_rated(spark, sf_dir)), cut(_similar(spark, sf_dir)))
    return rows.select("student_id", "concept_id", F.element_at(names, F.col("source")).alias("source"))


_FACTORS_SQL = f"""{_SIMILAR_SQL}, {_CANDIDATES_SQL}, mean_sim AS (SELECT student_id, avg(similarity) AS m FROM sim GROUP BY 1), votes AS (SELECT sim.student_id, r.concept_id, count(*) AS n, count(*) FILTER (rating > 0.7) AS good FROM sim JOIN rated r ON r.student_id = other GROUP BY 1, 2),
pre AS (SELECT c.student_id, c.concept_id, sum(CASE WHEN strength = 'STRONG' THEN 1.0 ELSE 0.5 END) AS need, sum(CASE WHEN r.rating >= 0.7 THEN CASE WHEN strength = 'STRONG' THEN 1.0 ELSE 0.5 END ELSE 0 END) AS met FROM cand c JOIN prerequisites p ON p.src = c.concept_id LEFT JOIN rated r ON r.student_id = c.student_id AND r.concept_id = p.dst GROUP BY 1, 2),
recent AS (SELECT student_id, concept_id, row_number() OVER (PARTITION BY student_id ORDER BY last DESC, concept_id) - 1 AS pos FROM rated, now WHERE epoch(as_of) - epoch(last) < 86400),
f AS (SELECT c.student_id, c.concept_id, coalesce(greatest(0.0, least(1.0, list_cosine_similarity(i, e))), 0.5) AS content, coalesce(good / n * m, 0.5) AS collaborative, coalesce(met / need, 1.0) AS prerequisite,
  greatest(0.0, least(1.0, 1 - abs((c.concept_id % 11) / 10 - greatest(0.1, least(0.9, least(0.9, level + 0.1)))) / 0.3)) AS difficulty, CASE WHEN r.last IS NULL THEN 1.0 WHEN d < 1 THEN 0.2 WHEN d < 3 THEN 0.5 WHEN d < 7 THEN 0.8 WHEN d < 14 THEN 0.9 ELSE 1.0 END AS recency, CASE WHEN pos < 10 THEN 0.5 - 0.05 * (10 - pos) ELSE 1.0 END AS diversity
  FROM cand c JOIN level USING (student_id) LEFT JOIN interest USING (student_id) LEFT JOIN vec USING (concept_id) LEFT JOIN mean_sim USING (student_id) LEFT JOIN votes USING (student_id, concept_id) LEFT JOIN pre USING (student_id, concept_id)
  LEFT JOIN (SELECT student_id, concept_id, last, floor((epoch(as_of) - epoch(last)) / 86400) AS d FROM rated, now) r USING (student_id, concept_id) LEFT JOIN recent USING (student_id, concept_id)),
sc AS (SELECT *, round(0.25 * content + 0.2 * collaborative + 0.2 * prerequisite + 0.15 * difficulty + 0.1 * recency + 0.1 * diversity, 6) AS score FROM f), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY score DESC, concept_id) AS place FROM sc) WHERE place <= 10)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each learner with the six factors and the weighted score."""
    rated, vec = cut(_rated(spark, sf_dir)), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("concept_id"), vectors.as_double(F.col("embedding")).alias("e"))
    levels, now = rated.groupBy("student_id").agg(F.avg("rating").alias("level")), rated.agg(F.max("last").alias("as_of"))
    dims = rated.where("rating >= 0.6").join(vec, "concept_id").select("student_id", F.posexplode("e").alias("dim", "x")).groupBy("student_id", "dim").agg(F.avg("x").alias("x"))
    interest = dims.groupBy("student_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("i"))
    similar = cut(_similar(spark, sf_dir))
    candidates = cut(_candidates(spark, sf_dir, rated, similar)).join(levels, "student_id")
    votes = similar.join(rated.select(F.col("student_id").alias("other"), "concept_id", "rating"), "other").groupBy("student_id", "concept_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("rating") > 0.7, 1)).alias("good"))
    weight = F.when(F.col("strength") == "STRONG", 1.0).otherwise(0.5)
    known = rated.select("student_id", F.col("concept_id").alias("dst"), "rating")
    pre = candidates.select("student_id", "concept_id").join(prerequisites(spark, sf_dir), F.col("concept_id") == F.col("src")).join(known, ["student_id", "dst"], "left").groupBy("student_id", "concept_id").agg(F.sum(weight).alias("need"), F.sum(F.when(F.col("rating") >= 0.7, weight).otherwise(0.0)).alias("met"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    studied = rated.join(F.broadcast(now)).select("student_id", "concept_id", "last", (seconds("as_of") - seconds("last")).alias("s"))
    recent = studied.where("s < 86400").withColumn("pos", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("last"), "concept_id")) - 1).select("student_id", "concept_id", "pos")
    rows = candidates.join(interest, "student_id", "left").join(vec, "concept_id", "left").join(similar.groupBy("student_id").agg(F.avg("similarity").alias("m")), "student_id", "left")
    for other in (votes, pre, studied.select("student_id", "concept_id", F.floor(F.col("s") / 86400).alias("d")), recent):
        rows = rows.join(other, ["student_id", "concept_id"], "left")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    best = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("level") + 0.1))
    d = F.col("d")
    rows = rows.select(
        "student_id", "concept_id", F.coalesce(clamp(vectors.cosine(F.col("i"), F.col("e"))), F.lit(0.5)).alias("content"), F.coalesce(F.col("good") / F.col("n") * F.col("m"), F.lit(0.5)).alias("collaborative"), F.coalesce(F.col("met") / F.col("need"), F.lit(1.0)).alias("prerequisite"),
        clamp(1 - F.abs(F.col("concept_id") % 11 / 10 - best) / 0.3).alias("difficulty"), F.when(d.isNull() | (d >= 14), 1.0).when(d < 1, 0.2).when(d < 3, 0.5).when(d < 7, 0.8).otherwise(0.9).alias("recency"), F.when(F.col("pos") < 10, F.round(0.5 - 0.05 * (10 - F.col("pos")), 2)).otherwise(1.0).alias("diversity"))
    return rows.withColumn("score", six(sum((weighted(f) for f in WEIGHTS), F.lit(0.0))))


def _top(rows: DataFrame, k: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("score"), "concept_id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= k)


@query(f"""WITH {_PROFILE_SQL}, {_FACTORS_SQL}, a AS (SELECT *, CASE greatest(0.25 * content, 0.2 * collaborative, 0.2 * prerequisite, 0.15 * difficulty, 0.1 * recency, 0.1 * diversity) WHEN 0.25 * content THEN 'content' WHEN 0.2 * collaborative THEN 'collaborative' WHEN 0.2 * prerequisite THEN 'prerequisite' WHEN 0.15 * difficulty THEN 'difficulty' WHEN 0.1 * recency THEN 'recency' ELSE 'diversity' END AS factor FROM top)
SELECT student_id, concept_id, place, round(content + 1e-9, 4) AS content, round(collaborative + 1e-9, 4) AS collaborative, round(prerequisite + 1e-9, 4) AS prerequisite, round(difficulty + 1e-9, 4) AS difficulty, round(recency + 1e-9, 4) AS recency, round(diversity + 1e-9, 4) AS diversity, round(score + 1e-9, 4) AS score, factor AS reason FROM a""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten concepts for each learner by six weighted factors, with the factor that weighs most."""
    rows = _top(_scored(spark, sf_dir))
    return rows.select("student_id", "concept_id", "place", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in (*WEIGHTS, "score")), reasons().alias("reason"))


@query(f"""WITH {_PROFILE_SQL}, {_FACTORS_SQL}, g AS (SELECT student_id, concept_id, concept_id % 6 AS topic, score, place, row_number() OVER (PARTITION BY student_id, concept_id % 6 ORDER BY place) AS nth FROM top)
SELECT student_id, concept_id, topic, round(CASE WHEN nth = 1 THEN score ELSE score * 0.7 END + 1e-9, 4) AS score FROM g WHERE nth = 1 OR score * 0.7 > 0.5""")
def diverse_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each topic as it is; others only if they score well after a deduction."""
    rows = _top(_scored(spark, sf_dir)).withColumn("topic", F.col("concept_id") % 6)
    return diverse(rows, "student_id", "topic", 0.5).select("student_id", "concept_id", "topic", F.round(F.col("score") + 1e-9, 4).alias("score"))


_CHUNKS_SQL = "ch AS (SELECT doc_id AS chunk, doc_id % 100 AS concept_id, (doc_id % 11) / 10 AS difficulty, n_chars, greatest(1, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) // 200) AS minutes FROM documents)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of concepts: difficulty and minutes of reading."""
    k, n = F.col("doc_id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return read(spark, sf_dir, "documents").select(k.alias("chunk"), (k % 100).alias("concept_id"), (k % 11 / 10).alias("difficulty"), "n_chars", F.greatest(F.lit(1), F.floor(n / 200)).alias("minutes"))


@query(f"""{_MASTERY_SQL}, {PREREQUISITES_SQL}, {_CHUNKS_SQL}, weak AS (SELECT DISTINCT w.student_id, w.concept_id AS concept, p.dst AS prerequisite FROM mastery w JOIN prerequisites p ON p.src = w.concept_id LEFT JOIN mastery m ON m.student_id = w.student_id AND m.concept_id = p.dst WHERE w.mastery < 0.4 AND coalesce(m.mastery, 0) < 0.7),
easy AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY difficulty, chunk) AS nth FROM ch WHERE difficulty <= 0.5), alt AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY n_chars, chunk) AS nth FROM ch)
SELECT student_id, concept, chunk, minutes, 0.9::DOUBLE AS score, 'prerequisite' AS reason FROM weak JOIN easy ON concept_id = prerequisite WHERE nth <= 2 UNION ALL SELECT student_id, w.concept, chunk, minutes, 0.85::DOUBLE, 'alternative' FROM (SELECT DISTINCT student_id, concept FROM weak) w JOIN alt ON concept_id = w.concept WHERE nth <= 1""")
def remedial_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For concepts that a learner has hardly understood: two easy chunks for each weak prerequisite, and another explanation."""
    known, chunks = _mastery(spark, sf_dir).select("student_id", "concept_id", "mastery"), _chunks(spark, sf_dir)
    low = known.where("mastery < 0.4").select("student_id", F.col("concept_id").alias("concept"))
    needs = low.join(prerequisites(spark, sf_dir).select(F.col("src").alias("concept"), F.col("dst").alias("prerequisite")).distinct(), "concept")
    weak = needs.join(known.select("student_id", F.col("concept_id").alias("prerequisite"), "mastery"), ["student_id", "prerequisite"], "left").where("coalesce(mastery, 0) < 0.7")
    nth = lambda *order: F.row_number().over(Window.partitionBy("concept_id").orderBy(*order))
    easy = chunks.where("difficulty <= 0.5").withColumn("nth", nth("difficulty", "chunk")).where("nth <= 2")
    other = chunks.withColumn("nth", nth("n_chars", "chunk")).where("nth = 1")
    made = lambda rows, score, reason: rows.select("student_id", "concept", "chunk", "minutes", F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    first = made(weak.join(easy, F.col("prerequisite") == F.col("concept_id")), 0.9, "prerequisite")
    return first.unionByName(made(weak.select("student_id", "concept").distinct().join(other, F.col("concept") == F.col("concept_id")), 0.85, "alternative"))


@query(f"""{_MASTERY_SQL}, {_CHUNKS_SQL}, p AS (SELECT student_id, concept_id, chunk, minutes, row_number() OVER (PARTITION BY student_id, concept_id ORDER BY CASE WHEN difficulty BETWEEN 0.3 AND 0.7 THEN 0 ELSE 1 END, abs(difficulty - mastery), chunk) AS place FROM mastery JOIN ch USING (concept_id) WHERE mastery < 0.7)
SELECT student_id, concept_id, chunk, minutes FROM p WHERE place = 1""")
def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk to read for each concept that is not known well: those in the level's range first, then the nearest difficulty."""
    # Of equal difficulty the first chunk is the one to read: a concept has as many as there are difficulties, however many chunks it has.
    firsts = _chunks(spark, sf_dir).groupBy("concept_id", "difficulty").agg(F.min_by(F.struct("chunk", "minutes"), "chunk").alias("c"))
    choices = firsts.groupBy("concept_id").agg(F.collect_list(F.struct("difficulty", "c.chunk", "c.minutes")).alias("choices"))
    rows = _mastery(spark, sf_dir).where("mastery < 0.7").select("student_id", "concept_id", "mastery").join(choices, "concept_id")
    order = lambda c: F.struct(F.when(c["difficulty"].between(0.3, 0.7), 0).otherwise(1).alias("band"), F.abs(c["difficulty"] - F.col("mastery")).alias("away"), c["chunk"].alias("chunk"), c["minutes"].alias("minutes"))
    return rows.withColumn("b", F.array_min(F.transform("choices", order))).select("student_id", "concept_id", "b.chunk", "b.minutes")


@query(f"""{_MASTERY_SQL}, {PREREQUISITES_SQL}, s AS (SELECT m.student_id, p.src AS concept_id, count(*) AS need, count(*) FILTER (m.mastery >= 0.5) AS met FROM mastery m JOIN prerequisites p ON p.dst = m.concept_id GROUP BY 1, 2),
n AS (SELECT src AS concept_id, count(*) AS total FROM prerequisites GROUP BY 1), c AS (SELECT student_id, concept_id, met, 10 * met + (concept_id % 11) / 10 AS score FROM s JOIN n USING (concept_id) WHERE met = total)
SELECT student_id, concept_id, met, round(score + 1e-9, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY score DESC, concept_id) AS place FROM c) WHERE place = 1""")
def next_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept to go on with: all that it requires is met, ten points for each and a bonus for difficulty."""
    edges = prerequisites(spark, sf_dir)
    met = _mastery(spark, sf_dir).join(edges, F.col("concept_id") == F.col("dst")).groupBy("student_id", F.col("src").alias("concept")).agg(F.count(F.when(F.col("mastery") >= 0.5, 1)).alias("met"))
    total = edges.groupBy(F.col("src").alias("concept")).agg(F.count("*").alias("total"))
    rows = met.join(total, "concept").where("met = total").withColumn("score", 10 * F.col("met") + F.col("concept") % 11 / 10)
    best = rows.groupBy("student_id").agg(F.max_by(F.struct("concept", "met", "score"), F.struct("score", -F.col("concept"))).alias("b"))
    return best.select("student_id", F.col("b.concept").alias("concept_id"), "b.met", F.round("b.score", 4).alias("score"))


@query(f"""{_MASTERY_SQL}, {_CHUNKS_SQL}, o AS (SELECT student_id, concept_id, row_number() OVER (PARTITION BY student_id ORDER BY mastery, concept_id) AS part FROM mastery WHERE mastery < 0.6), c AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY difficulty, chunk) AS nth FROM ch)
SELECT student_id, part, concept_id, count(*) AS chunks, count(*) * 5 AS minutes, string_agg(chunk, ',' ORDER BY nth) AS chunk_list, round(min(difficulty), 4) AS begins_at FROM o JOIN c USING (concept_id) WHERE part <= 4 AND nth <= 5 GROUP BY 1, 2, 3""")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learner's path: four segments, the weakest concept first, each with five chunks at most of five minutes."""
    part = F.row_number().over(Window.partitionBy("student_id").orderBy("mastery", "concept_id"))
    order = _mastery(spark, sf_dir).where("mastery < 0.6").withColumn("part", part.cast("long")).where("part <= 4").select("student_id", "part", "concept_id")
    chosen = _chunks(spark, sf_dir).groupBy("concept_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("difficulty", "chunk"))), 1, 5).alias("c"))
    n = F.size("c").cast("long")
    return order.join(chosen, "concept_id").select("student_id", "part", "concept_id", n.alias("chunks"), (n * 5).alias("minutes"), F.array_join(F.transform("c", lambda s: s["chunk"].cast("string")), ",").alias("chunk_list"), F.round(F.col("c")[0]["difficulty"], 4).alias("begins_at"))


