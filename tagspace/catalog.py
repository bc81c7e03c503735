"""Registered queries: one per operator of the survey, each with its oracle SQL.

Every query reads the given tables (or views Spark derives from them) whole.
``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is DuckDB SQL over
the same tables (absent where only a rows check is possible).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tagspace import oracle as O
from tagspace.functions import predicates as P
from tagspace.functions import text as T
from tagspace.operators import tags as TG
from tagspace.session import Scratch, cut_lineage
from tagspace.sources import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c, digits=6):
    return F.round(c.cast("double"), digits)


# --- text and calendar ----------------------------------------------------------

register("merge_groups", O.with_views(
    "SELECT post_id, party, grp FROM posts_doc", posts_doc=O.POSTS_DOC))(
    lambda spark, d: FX.posts_doc(spark, d).select("post_id", "party", "grp"))


@register("calendar_parts", O.with_views(
    """SELECT post_id, CAST(year(created_at) AS INTEGER) AS year,
              CAST(month(created_at) AS INTEGER) AS month,
              CAST(day(created_at) AS INTEGER) AS day FROM posts_doc""",
    posts_doc=O.POSTS_DOC))
def q_calendar(spark, d):
    p = FX.posts_doc(spark, d)
    p = T.with_day(T.with_month(T.with_year(p)))
    return p.select("post_id", "year", "month", "day")


@register("year_slice", O.with_views(
    """SELECT post_id, grp, CAST(year(created_at) AS INTEGER) AS year FROM posts_doc
       WHERE year(created_at) = 1997""", posts_doc=O.POSTS_DOC))
def q_year_slice(spark, d):
    p = T.with_year(FX.posts_doc(spark, d))
    return p.filter(P.year_is(1997)).select("post_id", "grp", "year")


DOC_TAG_PATTERN = r"\p{L}{5,}"


@register("year_range", O.with_views(
    f"""SELECT post_id, grp, year, n_tags FROM (
          SELECT post_id, grp, CAST(year(created_at) AS INTEGER) AS year,
                 CAST(len(regexp_extract_all(lower(text), '{DOC_TAG_PATTERN}')) AS INTEGER) AS n_tags
          FROM posts_doc)
        WHERE year BETWEEN 1996 AND 1998 AND n_tags > 0""", posts_doc=O.POSTS_DOC))
def q_year_range(spark, d):
    p = T.with_year(FX.posts_doc(spark, d))
    p = p.withColumn("tags", T.tags_of(F.lower("text"), DOC_TAG_PATTERN))
    p = T.with_n_tags(p)
    return p.filter(P.year_between(1996, 1998) & P.has_tags()).select(
        "post_id", "grp", "year", "n_tags")


@register("extract_tags", O.with_views(
    f"""SELECT post_id, array_to_string(t, ',') AS tags, CAST(len(t) AS INTEGER) AS n_tags
        FROM (SELECT post_id, regexp_extract_all(text, '{O.TAG_RE}') AS t FROM posts_event)""",
    posts_event=O.posts_event()))
def q_extract_tags(spark, d):
    p = T.with_n_tags(T.with_tags(FX.posts_event(spark, d)))
    return p.select("post_id", F.array_join("tags", ",").alias("tags"), "n_tags")


@register("match_tag_list", O.with_views(
    "SELECT post_id, grp FROM posts_event WHERE regexp_matches(text, '#k1|#k2')",
    posts_event=O.posts_event()))
def q_match_tag_list(spark, d):
    return TG.text_matches_tags(FX.posts_event(spark, d), ["k1", "k2"]).select("post_id", "grp")


_LIST_POSTS = """SELECT post_id, grp, CASE WHEN post_id % 4 = 0 THEN text || ' #k.1 #K1' ELSE text END AS text FROM posts_event"""


def _list_posts(spark, d):
    return FX.posts_event(spark, d).withColumn("text", F.when(
        F.col("post_id") % 4 == 0, F.concat("text", F.lit(" #k.1 #K1"))).otherwise(F.col("text")))


@register("match_tag_list_literal", O.with_views(
    "SELECT post_id, grp FROM lp WHERE contains(text, '#k.1') OR contains(text, '#u1')",
    posts_event=O.posts_event(), lp=_LIST_POSTS))
def q_match_tag_list_literal(spark, d):
    """F20 with entries as they are: the dot is a dot."""
    return TG.text_matches_tags(_list_posts(spark, d), ["k.1", "u1"], literal=True).select("post_id", "grp")


@register("match_tag_list_whole", O.with_views(
    f"""SELECT post_id, grp FROM lp WHERE list_has_any(regexp_extract_all(text, '{O.TAG_RE}'), ['#k1', '#k2', '#u7'])""",
    posts_event=O.posts_event(), lp=_LIST_POSTS))
def q_match_tag_list_whole(spark, d):
    """F20 by whole tags: ``#k10`` is no ``#k1``."""
    return TG.text_matches_tags(_list_posts(spark, d), ["k1", "k2", "u7"], whole_tag=True).select("post_id", "grp")


@register("match_tag_list_long", O.with_views(
    f"""SELECT post_id, grp FROM lp WHERE EXISTS (
          SELECT 1 FROM unnest(regexp_extract_all(text, '#u([0-9]+)', 1)) AS u(x)
          WHERE CAST(x AS BIGINT) % 7 = 0 AND CAST(x AS BIGINT) < 700000)""",
    posts_event=O.posts_event(), lp=_LIST_POSTS))
def q_match_tag_list_long(spark, d):
    """F20 by whole tags with a list of 100,000 entries."""
    return TG.text_matches_tags(_list_posts(spark, d), [f"u{i}" for i in range(0, 700_000, 7)], whole_tag=True) \
        .select("post_id", "grp")


# --- masks -----------------------------------------------------------------------

def _mask_query(name, pred_fn, sql_where, fixture="doc", gaps=False):
    if fixture == "doc":
        sql = O.with_views(f"SELECT post_id, grp FROM posts_doc WHERE {sql_where}",
                           posts_doc=O.POSTS_DOC)
    else:
        sql = O.with_views(f"SELECT post_id, grp FROM posts_event WHERE {sql_where}",
                           posts_event=O.posts_event(gaps))

    def fn(spark, d):
        p = FX.posts_doc(spark, d) if fixture == "doc" else FX.posts_event(spark, d, gaps=gaps)
        if name == "mask_no_hashtags":
            p = T.with_tags(p)
        return p.filter(pred_fn()).select("post_id", "grp")
    register(name, sql)(fn)


_mask_query("mask_time", lambda: P.month_between(3, 9), "month(created_at) BETWEEN 3 AND 9")
_mask_query("mask_elected", P.elected, "elected = 1")
_mask_query("mask_incumbent", P.incumbent, "incumbent = 1")
_mask_query("mask_reelected", P.reelected, "elected = 1 AND incumbent = 1")
_mask_query("mask_newly_elected", P.newly_elected, "elected = 1 AND incumbent = 0")
_mask_query("mask_not_reelected", P.not_reelected, "elected = 0 AND incumbent = 1")
_mask_query("mask_content", P.content,
            "is_retweet = 0 AND is_quoted = 0 AND is_reply = 0 AND NOT ends_with(text, '…')",
            fixture="event")
_mask_query("mask_no_hashtags", P.no_tags,
            f"len(regexp_extract_all(text, '{O.TAG_RE}')) = 0", fixture="event", gaps=True)
_mask_query("mask_random", lambda: P.random_keep(0.5, 42),
            f"{O.h32(O.key('42', 'post_id'))} < 0.5 * 4294967296", fixture="event")
_mask_query("mask_random_per_group", lambda: P.random_keep_per_group(0.5, 42),
            f"{O.h32(O.key('42', 'grp', 'post_id'))} < 0.5 * 4294967296", fixture="event")


# --- tags --------------------------------------------------------------------------

_EV_MENTIONS = dict(posts_event=O.posts_event(), mentions=O.mentions_of("posts_event"))


@register("tag_counts", O.with_views(
    """SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT post_id) AS BIGINT) AS n_posts
       FROM mentions GROUP BY tag""", **_EV_MENTIONS))
def q_tag_counts(spark, d):
    m = TG.mentions(FX.posts_event(spark, d))
    a = TG.tag_counts(m, "mentions")
    b = TG.tag_counts(m, "posts").withColumnRenamed("n", "n_posts")
    return a.join(b, "tag")


@register("tag_groups", O.with_views(
    """SELECT tag, CAST(count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) AS BIGINT)
                  AS n_groups,
              array_to_string(list_sort(list(DISTINCT grp)), ',') AS groups
       FROM mentions GROUP BY tag""", **_EV_MENTIONS))
def q_tag_groups(spark, d):
    return TG.tag_groups(TG.mentions(FX.posts_event(spark, d)))


_COMMON_SQL = """
  SELECT tag, CAST(count(*) AS BIGINT) AS n,
         CAST(count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_groups
  FROM mentions GROUP BY tag
  HAVING count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) >= {g}
     AND count(*) >= {t}"""


@register("common_tags", O.with_views(_COMMON_SQL.format(g=5, t=50), **_EV_MENTIONS))
def q_common_tags(spark, d):
    return TG.common_tags(TG.mentions(FX.posts_event(spark, d)), num_groups=5, threshold=50)


@register("tag_cooccurrence", O.with_views(
    """SELECT DISTINCT a.tag, b.tag AS other FROM mentions a JOIN mentions b USING (post_id)
       WHERE a.tag IN (SELECT tag FROM common)""",
    **_EV_MENTIONS, common=_COMMON_SQL.format(g=5, t=50)))
def q_tag_cooccurrence(spark, d):
    posts = FX.posts_event(spark, d)
    common = TG.common_tags(TG.mentions(posts), num_groups=5, threshold=50)
    return TG.tag_cooccurrence(posts, common)


# --- vectors and distance matrices ---------------------------------------------------

from tagspace.operators import distance as DS  # noqa: E402
from tagspace.operators import salience as SL  # noqa: E402
from tagspace.operators.mantel import mantel  # noqa: E402
from tagspace.plans import experiment as XP  # noqa: E402
from tagspace.plans.grid import Config, readme_grid  # noqa: E402

# listed groups of the event fixture (the reference's ``parties`` argument)
EVENT_GROUPS = ["click", "error", "purchase", "signup", "view"]
SALIENCE_YEAR = 1997


DIM = FX.EMBEDDING_DIM


def places(v, power=1):
    """Sum of i**power * v[i] (i from 1): it changes when elements change places."""
    at = F.sequence(F.lit(1), F.size(v))
    return F.aggregate(F.zip_with(v, at, lambda x, i: x.cast("double") * F.pow(i, F.lit(power))),
                       F.lit(0.0), lambda acc, x: acc + x)


def _label_vectors(spark, d):
    return (FX.table(spark, d, "embeddings")
            .select(F.col("label").cast("string").alias("grp"), "vec_id", "embedding"))


@register("category_distance", O.with_views(
    """SELECT a.grp AS g1, b.grp AS g2, round(sum(1 - list_dot_product(a.u, b.u)), 4) AS dist_sum,
              round(avg(1 - list_dot_product(a.u, b.u)), 6) AS dist_mean
       FROM lv a JOIN lv b ON a.grp < b.grp GROUP BY a.grp, b.grp""",
    lvraw="SELECT vec_id AS post_id, CAST(label AS VARCHAR) AS grp, embedding FROM embeddings",
    lvu=O.unit_of("lvraw"),
    lv="SELECT r.grp, u.u FROM lvraw r JOIN lvu u USING (post_id)"))
def q_category_distance(spark, d):
    v = _label_vectors(spark, d)
    dim = DIM
    s = DS.category_distance(v, "sum", dim=dim).withColumnRenamed("value", "dist_sum")
    m = DS.category_distance(v, "mean", dim=dim).withColumnRenamed("value", "dist_mean")
    return s.join(m, ["g1", "g2"]).select("g1", "g2", _r(F.col("dist_sum"), 4).alias("dist_sum"),
                                          _r(F.col("dist_mean")).alias("dist_mean"))


def _event_profile(spark, d, num_groups=5, threshold=50):
    posts = FX.posts_event(spark, d)
    ments = TG.mentions(posts)
    common = cut_lineage(TG.common_tags(ments, num_groups, threshold))
    ments = TG.restrict_to(ments, common).join(DS.often_used(common), "tag", "left")
    dim = DIM
    prof = DS.tag_group_vectors(ments, FX.event_embeddings(spark, d), EVENT_GROUPS, dim=dim)
    # tags × groups rows, the narrow waist every matrix reads: written once
    return cut_lineage(DS.complete_tags(prof, len(EVENT_GROUPS)))


_EV_VEC = dict(posts_event=O.posts_event(), mentions0=O.mentions_of("posts_event"),
               emb=O.EVENT_EMB, eu=O.unit_of("emb"),
               mentions="SELECT m.*, eu.u FROM mentions0 m JOIN eu USING (post_id)")


@register("tag_group_vectors", O.with_views(
    """SELECT a.tag, a.grp, CAST(count(DISTINCT a.post_id || ':' || a.pos) AS BIGINT) AS n,
              round(sqrt(sum(list_dot_product(a.u, b.u))), 6) AS s_norm,
              round(max(w.s1), 5) AS s_places, round(max(w.s2), 3) AS s_places2
       FROM mcp a JOIN mcp b ON a.tag = b.tag AND a.grp = b.grp
       JOIN (SELECT tag, grp, sum(""" + O.weighted_sum("u") + """) AS s1,
                    sum(""" + O.weighted_sum("u", 2) + """) AS s2 FROM mcp GROUP BY tag, grp) w
         ON w.tag = a.tag AND w.grp = a.grp GROUP BY a.tag, a.grp""",
    **_EV_VEC, **{k: v for k, v in O.tag_matrix_views("mentions", EVENT_GROUPS, 5, 50).items()
                  if k in ("common", "mu", "complete", "mc")},
    mcp="SELECT * FROM mc"))
def q_tag_group_vectors(spark, d):
    p = _event_profile(spark, d)
    return p.select("tag", "grp", "n", _r(F.sqrt(DS.dot("s", "s"))).alias("s_norm"),
                    _r(places("s"), 5).alias("s_places"), _r(places("s", 2), 3).alias("s_places2"))


def _tag_matrix_sql(agg):
    v = O.tag_matrix_views("mentions", EVENT_GROUPS, 5, 50, agg=agg)
    return O.with_views(f"SELECT g1, g2, round(value, {4 if agg == 'sum' else 6}) AS value "
                        "FROM xmat", **_EV_VEC, **v)


@register("tag_distance_matrix", _tag_matrix_sql("sum"))
def q_tag_distance_matrix(spark, d):
    m = DS.tag_distance_matrix(_event_profile(spark, d), (), "sum", dim=DIM)
    return m.select("g1", "g2", _r(F.col("value"), 4).alias("value"))


@register("tag_distance_matrix_mean", _tag_matrix_sql("mean"))
def q_tag_distance_matrix_mean(spark, d):
    m = DS.tag_distance_matrix(_event_profile(spark, d), (), "mean", dim=DIM)
    return m.select("g1", "g2", _r(F.col("value")).alias("value"))


def _salience_query(mode):
    def sql_of(drop):
        v = O.salience_matrix_views(mode, drop, mapped=False)
        return f"SELECT g1, g2, {str(drop).upper()} AS drop_first, round(value, 6) AS value FROM ({O.with_views('SELECT * FROM ymat', **v)})"
    sql = sql_of(True) + " UNION ALL " + sql_of(False)

    def fn(spark, d):
        wide = FX.salience_wide(spark, d)
        segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
        out = None
        for drop in (True, False):
            m = SL.salience_matrix(wide, SALIENCE_YEAR, segs, mode, drop_first=drop)
            m = m.select("g1", "g2", F.lit(drop).alias("drop_first"), _r(F.col("value")).alias("value"))
            out = m if out is None else out.unionByName(m)
        return out
    register(f"salience_matrix_{mode}", sql)(fn)


for _mode in SL.MODES:
    _salience_query(_mode)


def event_salience(spark, d, mode="full"):
    """Salience matrix with segments renamed to the event groups (group_map)."""
    gm = FX.group_map(spark, d).select("seg", "grp")
    return SL.salience_matrix(FX.salience_wide(spark, d), SALIENCE_YEAR, EVENT_GROUPS, mode,
                              name_map=gm)


def _mantel_sql(method):
    v = O.tag_matrix_views("mentions", EVENT_GROUPS, 5, 50)
    s = O.salience_matrix_views("full", True, mapped=True)
    mv = O.mantel_views(EVENT_GROUPS, methods=(method,))
    return O.with_views("SELECT method, round(r, 6) AS r, round(p, 6) AS p, round(z, 6) AS z, "
                        "n_perm, method_exact FROM mres", **_EV_VEC, **v, **s, **mv)


def _mantel_query(method):
    def fn(spark, d):
        x = DS.tag_distance_matrix(_event_profile(spark, d), dim=DIM)
        y = event_salience(spark, d)
        res = mantel(x, y, EVENT_GROUPS, methods=(method,))
        return res.select("method", _r(F.col("r")).alias("r"), _r(F.col("p")).alias("p"),
                          _r(F.col("z")).alias("z"), "n_perm", "method_exact")
    register(f"mantel_{method}", _mantel_sql(method))(fn)


_mantel_query("pearson")
_mantel_query("spearman")


# --- the experiment ------------------------------------------------------------------

def _experiment_query(name, configs, threshold=50):
    def fn(spark, d):
        posts = FX.posts_event(spark, d)
        emb = FX.event_embeddings(spark, d)
        res = XP.experiment_grid(posts, emb, event_salience(spark, d), EVENT_GROUPS, configs,
                                 num_groups=5, threshold=threshold, dim=DIM)
        return res.select("config", "marker", "method", _r(F.col("r")).alias("r"),
                          _r(F.col("p")).alias("p"), _r(F.col("z")).alias("z"), "n_perm", "n_tags")
    register(name, O.experiment_sql(configs, EVENT_GROUPS, 5, threshold))(fn)


_experiment_query("experiment", [Config("full")])
_experiment_query("experiment_grid", readme_grid(), 20)


# --- twin matching -----------------------------------------------------------------

from tagspace.operators import twin as TW  # noqa: E402


def _twin_vectors(spark, d):
    return _label_vectors(spark, d).select(F.col("vec_id").alias("id"), "grp", "embedding")


@register("twin_similarity_matrix", O.with_views(
    "SELECT g1, g2, round(value, 6) AS value FROM sim", **O.twin_views()))
def q_twin_similarity(spark, d):
    m = TW.twin_similarity_matrix(_twin_vectors(spark, d))
    return m.select("g1", "g2", _r(F.col("value")).alias("value"))


@register("twin_distance_matrix", O.with_views(
    "SELECT g1, g2, round(value, 6) AS value FROM dist", **O.twin_views()))
def q_twin_distance(spark, d):
    m = TW.twin_distance_matrix(_twin_vectors(spark, d))
    return m.select("g1", "g2", _r(F.col("value")).alias("value"))


@register("twin_nearest_clustered", O.with_views(
    """SELECT tw.a_id, tw.gb AS g, round(tw.best, 6) AS best_sim, tw.t_id AS best_id, round(x.excl, 6) AS excl_sim
       FROM tw LEFT JOIN (SELECT a_id, gb, max(s) AS excl FROM sims WHERE a_id <> b_id GROUP BY ALL) x
         ON x.a_id = tw.a_id AND x.gb = tw.gb""", **O.twin_views(O.CLUSTERED)))
def q_twin_nearest_clustered(spark, d):
    """V4 on vectors with clusters, searched by cells (of about 16 vectors, as the tables are small),
    whatever share of the pairs the bounds leave."""
    rows, _ = TW.nearest_pruned(FX.clustered_vectors(spark, d), most=1.0, cell_rows=16)
    return rows.select("a_id", "g", _r(F.col("best_sim")).alias("best_sim"), "best_id", _r(F.col("excl_sim")).alias("excl_sim"))


# --- pair datasets --------------------------------------------------------------------

from tagspace.operators import pairs as PR  # noqa: E402

PAIR_ARGS = dict(num_groups=5, threshold=10, seed=42, n_samples=230)
_PV = O.pair_views(5, 10, 42, 230)


@register("positive_pairs", O.with_views("SELECT tag, id1, id2 FROM pp", **_PV))
def q_positive_pairs(spark, d):
    _, pos, _ = PR.pair_parts(FX.posts_event(spark, d), **PAIR_ARGS)
    return pos


@register("clean_negatives", O.with_views("SELECT tag, post_id FROM neg", **_PV))
def q_clean_negatives(spark, d):
    posts = FX.posts_event(spark, d)
    tp = PR.tagged_posts(posts)
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = TG.common_tags(ments, 5, 10).select("tag")
    cooc = TG.tag_cooccurrence(tp, common)
    return PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42).select(
        "tag", "post_id")


@register("clean_negatives_hot_tag", O.with_views(
    "SELECT tag, post_id FROM neg", **O.pair_views(5, 10, 42, 230, hot=True)))
def q_clean_negatives_hot(spark, d):
    """Clean negatives where one tag is on nine posts in ten."""
    tp = PR.tagged_posts(FX.with_hot_tag(FX.posts_event(spark, d)))
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = TG.common_tags(ments, 5, 10).select("tag")
    return PR.clean_negatives(tp.select("post_id", "tags"), common, TG.tag_cooccurrence(tp, common), 42).select(
        "tag", "post_id")


@register("clean_negatives_twenty_heavy_tags", O.with_views(
    "SELECT tag, post_id FROM neg", **O.pair_views(5, 10, 42, 230, heavy=20)))
def q_clean_negatives_heavy(spark, d):
    """Clean negatives where each of twenty tags is on three posts in ten."""
    tp = cut_lineage(PR.tagged_posts(FX.with_heavy_tags(FX.posts_event(spark, d), 20)).select("post_id", "grp", "tags"))
    ments = tp.select("post_id", "grp", F.posexplode("tags").alias("pos", "tag"))
    common = cut_lineage(TG.common_tags(ments, 5, 10).select("tag"))
    cooc = PR.tag_cooccurrence_of_lists(tp, common)
    return PR.clean_negatives(tp.select("post_id", "tags"), common, cooc, 42).select("tag", "post_id")


@register("negative_pairs", O.with_views("SELECT tag, id1, id2 FROM np", **_PV))
def q_negative_pairs(spark, d):
    _, _, neg = PR.pair_parts(FX.posts_event(spark, d), **PAIR_ARGS)
    return neg


@register("pair_dataset", O.with_views("SELECT * FROM pairs", **_PV))
def q_pair_dataset(spark, d):
    return PR.pair_dataset(FX.posts_event(spark, d), **PAIR_ARGS)


@register("pair_split", O.with_views("SELECT * FROM split", **_PV))
def q_pair_split(spark, d):
    ds = PR.pair_dataset(FX.posts_event(spark, d), **PAIR_ARGS)
    return PR.split_dataset(ds, seed=42).select("tag", "id1", "id2", "label", "split")


# --- masked embeddings, pair evaluation, encoders -------------------------------------

from tagspace.operators import embed as EM  # noqa: E402
from tagspace.operators import masks as MK  # noqa: E402
from tagspace.operators.evaluate import pair_similarity_eval  # noqa: E402


def _element_columns():
    return [_r(F.col("embedding")[0]).alias("e0"), _r(places("embedding"), 4).alias("e_places"),
            _r(places("embedding", 2), 2).alias("e_places2")]


def _vector_columns():
    """Columns that tell a stored vector from any other order or choice of its elements."""
    return [_r(F.col("embedding")[0]).alias("first"),
            _r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"),
            _r(places("embedding"), 5).alias("places"), _r(places("embedding", 2), 3).alias("places2")]


@register("masked_embeddings", O.with_views(
    """SELECT p.post_id, p.grp, round(CAST(e.embedding[1] AS DOUBLE), 6) AS e0,
              round(""" + O.weighted_sum("CAST(e.embedding AS DOUBLE[])") + """, 4) AS e_places,
              round(""" + O.weighted_sum("CAST(e.embedding AS DOUBLE[])", 2) + """, 2) AS e_places2
       FROM posts_event p JOIN emb e USING (post_id)
       WHERE p.is_retweet = 0 AND p.is_quoted = 0 AND p.is_reply = 0 AND NOT ends_with(p.text, '…')
         AND p.grp <> 'other'""", posts_event=O.posts_event(), emb=O.EVENT_EMB))
def q_masked_embeddings(spark, d):
    m = MK.apply_mask(FX.posts_event(spark, d), FX.event_embeddings(spark, d), P.content(),
                      EVENT_GROUPS, check=True)
    return m.select("post_id", "grp", *_element_columns())


@register("pair_similarity_eval", O.with_views(
    "SELECT metric, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, n_pairs, n_scored FROM res",
    **O.eval_views()))
def q_pair_similarity_eval(spark, d):
    pairs = FX.label_pairs(spark, d)
    emb = FX.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    r = pair_similarity_eval(pairs, emb)
    return r.select("metric", _r(F.col("pearson")).alias("pearson"),
                    _r(F.col("spearman")).alias("spearman"), "n_pairs", "n_scored")


@register("word_average", O.with_views(
    """SELECT p.post_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_tokens,
              round(coalesce(a.s0 / a.n, 0.0), 6) AS first, round(coalesce(a.st / a.n, 0.0), 6) AS total,
              round(coalesce(a.s1 / a.n, 0.0), 5) AS places, round(coalesce(a.s2 / a.n, 0.0), 3) AS places2
       FROM posts_doc p LEFT JOIN
         (SELECT t.post_id, sum(t.c) AS n, sum(t.c * w.first_u) AS s0, sum(t.c * w.total_u) AS st,
                 sum(t.c * w.places_u) AS s1, sum(t.c * w.places2_u) AS s2
          FROM tc t JOIN wv w ON w.vec_id = t.h % (SELECT count(*) FROM embeddings)
          WHERE t.h % 4 <> 0 GROUP BY t.post_id) a USING (post_id)""",
    **O.doc_token_views(blanks=True),
    tc="SELECT post_id, tok, any_value(h) AS h, count(*) AS c FROM th GROUP BY post_id, tok",
    wraw="SELECT vec_id AS post_id, embedding FROM embeddings",
    wu=O.unit_of("wraw"),
    wv="SELECT post_id AS vec_id, u[1] AS first_u, list_sum(u) AS total_u, " + O.weighted_sum("u")
       + " AS places_u, " + O.weighted_sum("u", 2) + " AS places2_u FROM wu"))
def q_word_average(spark, d):
    posts = FX.with_blank_texts(FX.posts_doc(spark, d))
    wa = EM.word_average(posts, FX.doc_words(spark, d), dim=DIM)
    return wa.select("post_id", "n_tokens", *_vector_columns())


def _hash_sql(columns="p.post_id, coalesce(a.n_tokens, 0) AS n_tokens", year=None, blanks=True):
    """Hashed vectors of posts_doc by brute force: cells per bucket, then sums over buckets."""
    def value(c, digits):
        return f"round(coalesce(a.{c} / a.nrm, 0.0), {digits})"
    return O.with_views(
        f"""SELECT {columns}, {value('v0', 6)} AS first, {value('vs', 6)} AS total,
                   {value('v1', 5)} AS places, {value('v2', 3)} AS places2
            FROM posts_doc p LEFT JOIN
             (SELECT post_id, CAST(sum(c) AS BIGINT) AS n_tokens, greatest(sqrt(sum(v * v)), 1e-12) AS nrm,
                     sum(v) AS vs, coalesce(max(CASE WHEN b = 0 THEN v END), 0.0) AS v0,
                     sum(v * (b + 1)) AS v1, sum(v * (b + 1) * (b + 1)) AS v2
              FROM (SELECT post_id, h % 32 AS b, sum(CASE WHEN h < 2147483648 THEN 1.0 ELSE -1.0 END) AS v,
                           count(*) AS c FROM th GROUP BY ALL)
              GROUP BY post_id) a USING (post_id)""", **O.doc_token_views(year, blanks))


@register("hash_embeddings", _hash_sql())
def q_hash_embeddings(spark, d):
    he = EM.hash_embed(FX.with_blank_texts(FX.posts_doc(spark, d)), 32)
    return he.select("post_id", "n_tokens", *_vector_columns())


def length_encoder():
    """An encoder for the hook: lengths of the text in characters, words and lines."""
    import numpy as np

    def enc(texts):
        return np.array([[len(t), len(t.split()), t.count("e")] for t in texts], dtype="float64").reshape(-1, 3)
    return enc


@register("encoder_hook", O.with_views(
    """SELECT CAST(post_id AS VARCHAR) || 'x' AS post_id, CAST(length(t) AS DOUBLE) AS chars,
              CAST(len(regexp_extract_all(t, '[^ ]+')) AS DOUBLE) AS words,
              CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS es
       FROM (SELECT post_id, replace(replace(coalesce(text, ''), chr(10), ' '), chr(9), ' ') AS t FROM posts_doc)""",
    posts_all=O.POSTS_DOC, posts_doc=O.BLANK))
def q_encoder_hook(spark, d):
    """Any encoder over batches; the ids here are strings."""
    EM.register_encoder("length-3", length_encoder)
    posts = FX.with_blank_texts(FX.posts_doc(spark, d))
    posts = posts.withColumn("post_id", F.concat(F.col("post_id").cast("string"), F.lit("x")))
    e = EM.encode_batches(posts, length_encoder, 3, out_type="double")
    return e.select("post_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(["chars", "words", "es"])])


# --- jobs: files in and out ------------------------------------------------------------

from tagspace.plans import jobs as JB  # noqa: E402
from tagspace.sources import files as FS  # noqa: E402
from tagspace.sources import sinks as SK  # noqa: E402

EVENT_POST_SCHEMA = ("post_id long, grp string, created_at timestamp_ntz, text string, "
                     "elected int, incumbent int, is_retweet int, is_quoted int, is_reply int")
DOC_POST_SCHEMA = ("post_id long, party string, text string, lang string, "
                   "created_at timestamp_ntz, elected int, incumbent int, grp string")


def _as_csv(df, spark, name):
    path = SK.scratch_path(spark, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


_QUOTED = """CASE WHEN post_id % 3 = 0 THEN '"' || text || '",' || chr(10) || chr(10) || 'x""' ELSE text END"""


@register("read_csv_ranges", O.with_views(
    f"""SELECT post_id, party, grp, CAST(year(created_at) AS INTEGER) AS year, elected, md5({_QUOTED}) AS text_md5,
              length({_QUOTED}) AS text_length FROM posts_doc WHERE year(created_at) BETWEEN 1995 AND 1997""",
    posts_doc=O.POSTS_DOC))
def q_read_csv_ranges(spark, d):
    """Posts whose texts have line breaks, quotes and separators, written as CSV and read back
    in byte ranges (64 KiB here, so that small tables have many; by default the session's)."""
    quoted = F.concat(F.lit('"'), "text", F.lit('",\n\nx""'))
    posts = FX.posts_doc(spark, d).withColumn(
        "text", F.when(F.col("post_id") % 3 == 0, quoted).otherwise(F.col("text")))
    src = _as_csv(posts, spark, "posts-quoted-csv")
    df = FS.read_rows(spark, src, "csv", DOC_POST_SCHEMA, range_bytes=1 << 16)
    df = T.with_year(df).filter(P.year_between(1995, 1997))
    return df.select("post_id", "party", "grp", "year", "elected", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                     F.length("text").cast("long").alias("text_length"))


@register("filter_job", O.with_views(
    """SELECT p.post_id, p.grp, round(CAST(e.embedding[1] AS DOUBLE), 6) AS e0,
              round(""" + O.weighted_sum("CAST(e.embedding AS DOUBLE[])") + """, 4) AS e_places,
              round(""" + O.weighted_sum("CAST(e.embedding AS DOUBLE[])", 2) + """, 2) AS e_places2
       FROM posts_event p JOIN emb e USING (post_id)
       WHERE p.is_retweet = 0 AND p.is_quoted = 0 AND p.is_reply = 0 AND NOT ends_with(p.text, '…')
         AND p.grp <> 'other'""", posts_event=O.posts_event(), emb=O.EVENT_EMB))
def q_filter_job(spark, d):
    out = JB.filter_job(FX.posts_event(spark, d), FX.event_embeddings(spark, d),
                        SK.scratch_path(spark, "filtered"), "content", EVENT_GROUPS)
    back = spark.read.parquet(out).filter((F.col("mode") == "content")
                                          & (F.col("config") == "content"))
    return back.select("post_id", "grp", *_element_columns())


@register("gather_job", O.with_views("SELECT sent1, sent2, label, split FROM split_texts", **_PV))
def q_gather_job(spark, d):
    src = _as_csv(FX.posts_event(spark, d), spark, "posts-event-csv")
    out = JB.gather_job(spark, src, SK.scratch_path(spark, "pairs"), 2024, 2024,
                        num_groups=5, threshold=10, n_samples=230, seed=42,
                        schema=EVENT_POST_SCHEMA, id_col="post_id", group_col="grp", merge={})
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .schema("sent1 string, sent2 string, label int, year string, split string").csv(out)
    return back.select("sent1", "sent2", "label", "split")


@register("embed_job", "SELECT post_id, year, first, total, places, places2 FROM ("
          + _hash_sql("p.post_id, 1997 AS year", 1997, False) + ") UNION ALL SELECT post_id, year, first, total, places, places2 FROM ("
          + _hash_sql("p.post_id, 1998 AS year", 1998, False) + ")")
def q_embed_job(spark, d):
    """Two years into one folder, one of them twice: each year is there once."""
    src = _as_csv(FX.posts_doc(spark, d), spark, "posts-doc-csv")
    out = SK.scratch_path(spark, "emb")
    for year in (1997, 1998, 1997):
        JB.embed_job(spark, src, out, year, model="hash/32", groups=None, schema=DOC_POST_SCHEMA,
                     id_col="post_id", group_col="party", merge=FX.DOC_MERGE)
    back = FS.read_embeddings(spark, out, "hash_32")
    return back.select("post_id", "year", *_vector_columns())


@register("evaluate_job", O.with_views(
    "SELECT metric, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, n_pairs, n_scored FROM res",
    **O.evaluate_job_views()))
def q_evaluate_job(spark, d):
    src = _as_csv(FX.posts_event(spark, d), spark, "posts-event-csv")
    out = JB.gather_job(spark, src, SK.scratch_path(spark, "pairs"), 2024, 2024,
                        num_groups=5, threshold=10, n_samples=230, seed=42,
                        schema=EVENT_POST_SCHEMA, id_col="post_id", group_col="grp", merge={})
    kept = SK.scratch_path(spark, "evaluation")
    for _ in range(2):  # a repeated evaluation replaces its own rows
        JB.evaluate_job(spark, out, "val", out=kept)
    r = spark.read.parquet(kept).where("model = 'hash-32' AND split = 'val'")
    return r.select("metric", _r(F.col("pearson")).alias("pearson"),
                    _r(F.col("spearman")).alias("spearman"), "n_pairs", "n_scored")


_MODEL, _EVAL = "hash-32", "full_manifesto_matrix"
_RESULT_CONFIGS = [Config("full"), Config("time", month_start=3, month_end=9), Config("elected")]


@register("results_job", O.results_sql(_RESULT_CONFIGS, EVENT_GROUPS, 5, 50, _MODEL, 2024, _EVAL))
def q_results_job(spark, d):
    """X1 by path + S1, S3, S4, S9: posts, embeddings and salience table are written, the job
    reads them, and its committed result rows are read back; it runs twice, and each row is there once."""
    posts = _as_csv(FX.posts_event(spark, d), spark, "posts-event-csv")
    emb = SK.scratch_path(spark, "emb")
    vecs = FX.event_embeddings(spark, d).withColumn("grp", F.lit("any"))
    SK.write_embeddings(vecs, emb, _MODEL, 2024)
    table = _as_csv(FX.salience_wide(spark, d).withColumn(
        "date", F.col("date") - 199709 + 202409), spark, "salience-csv")
    out = SK.scratch_path(spark, "results")
    for _ in range(2):
        JB.experiment_job(
            spark, posts, emb, table, out, 2024, _MODEL, EVENT_GROUPS, _RESULT_CONFIGS,
            name_map=FX.group_map(spark, d).select("seg", "grp"), schema=EVENT_POST_SCHEMA,
            id_col="post_id", group_col="grp", merge={}, num_groups=5, threshold=50, dim=DIM)
    back = SK.read_results(spark, out)
    numbers = [c for c in back.columns if c[:2] in ("r_", "p_", "z_")]
    return back.select("model", "year", "mode", "eval", *[_r(F.col(c)).alias(c) for c in numbers])


# --- sources and names ------------------------------------------------------------------

@register("config_marker", f"""SELECT doc_id, {O.MARKER} AS marker, source || '-' || lang AS model FROM (
    SELECT doc_id, source, lang, ['full', 'random', 'time', 'elected'][doc_id % 4 + 1] AS mode, doc_id % 7 AS seed,
           CAST((doc_id % 8 + 1) / 8.0 AS DOUBLE) AS fraction, doc_id % 9 + 1 AS month_start,
           9 AS month_end FROM documents)""")
def q_config_marker(spark, d):
    """The marker of a run, the model in the name of its embedding file."""
    i = F.col("doc_id")
    runs = FX.table(spark, d, "documents").select(
        "doc_id", F.array(*[F.lit(m) for m in ("full", "random", "time", "elected")])[(i % 4).cast("int")].alias("mode"),
        (i % 7).alias("seed"), ((i % 8 + 1) / 8.0).alias("fraction"), (i % 9 + 1).alias("month_start"),
        F.lit(9).alias("month_end"),
        F.concat(F.lit("/data/emb/"), "source", F.lit("-"), "lang", F.lit("-2013.pkl")).alias("path"))
    return runs.select("doc_id", T.config_marker(
        *[F.col(c) for c in ("mode", "seed", "fraction", "month_start", "month_end")]).alias("marker"), T.model_from_path(F.col("path")).alias("model"))


@register("read_embeddings", O.with_views(
    """SELECT post_id, 'any' AS grp, 2017 AS year, 'org_m-x' AS model,
              round(CAST(embedding[1] AS DOUBLE), 6) AS e0,
              round(""" + O.weighted_sum("CAST(embedding AS DOUBLE[])") + """, 4) AS e_places,
              round(""" + O.weighted_sum("CAST(embedding AS DOUBLE[])", 2) + """, 2) AS e_places2
       FROM emb WHERE post_id % 2 = 1""", emb=O.EVENT_EMB))
def q_read_embeddings(spark, d):
    """Two years of one model, and another model; one is read back."""
    vecs = FX.event_embeddings(spark, d).withColumn("grp", F.lit("any"))
    out = SK.scratch_path(spark, "emb")
    SK.write_embeddings(vecs.filter("post_id % 2 = 0"), out, "org/m-x", 2013)
    SK.write_embeddings(vecs.filter("post_id % 2 = 1"), out, "org/m-x", 2017)
    SK.write_embeddings(vecs, out, "other", 2017)
    back = FS.read_embeddings(spark, out, "org_m-x", 2017)
    return back.select("post_id", "grp", "year", "model", *_element_columns())


@register("read_salience", O.with_views(
    """SELECT date, countryname, partyabbrev, round(pervote, 6) AS pervote, round(per101, 6) AS per101,
              round(per103_1, 6) AS per103_1, round(per105, 6) AS per105, round(per601, 6) AS per601
       FROM salience""", own=O.salience_wide()[1], salience=O.salience_wide()[0]))
def q_read_salience(spark, d):
    """The table through a CSV file, types inferred."""
    t = FS.read_salience(spark, _as_csv(FX.salience_wide(spark, d), spark, "salience-csv"))
    numbers = ["pervote", "per101", "per103_1", "per105", "per601"]
    return t.select("date", "countryname", "partyabbrev", *[_r(F.col(c)).alias(c) for c in numbers])


@register("read_pairs", O.with_views(
    """SELECT year, sent1, sent2, label, split FROM split_texts, (SELECT unnest(['2013', '2017_b']) AS year)""", **_PV))
def q_read_pairs(spark, d):
    """The pairs of two years in one folder, one of them written twice; Parquet posts."""
    src = SK.scratch_path(spark, "posts")
    FX.posts_event(spark, d).write.parquet(src)
    posts = FS.read_posts_range(spark, src, 2024, 2024, EVENT_POST_SCHEMA, id_col="post_id",
                                group_col="grp", merge={}, fmt="parquet")
    scratch = Scratch(spark)  # the dataset is written there once, and read by each of the writes
    ds = PR.split_dataset(PR.pair_dataset(posts, **PAIR_ARGS, scratch=scratch), 42)
    train, val = ds.filter("split = 'train'"), ds.filter("split = 'val'")
    out = SK.scratch_path(spark, "pairs")
    for year, suffix in ((2013, None), (2017, "b"), (2013, None)):
        SK.write_pairs(train, val, out, year, suffix)
    scratch.clear()
    parts = [FS.read_pairs(spark, f"{out}/year={y}", split=p).withColumns({"year": F.lit(y), "split": F.lit(p)})
             for y in ("2013", "2017_b") for p in ("train", "val")]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.select("year", "sent1", "sent2", "label", "split")
