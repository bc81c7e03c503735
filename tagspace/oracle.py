"""DuckDB forms of the test views, used by the oracle SQL of every query.

Each view is a CTE body over the pre-registered tables. The Spark forms are in
``tagspace.sources.fixtures``; both must agree row for row.
"""

from __future__ import annotations

import math

TAG_RE = r"#[\p{L}\p{N}_]+"


def h32(expr: str) -> str:
    """First 32 bits of md5 as BIGINT (same value as ``hashing.hash32``)."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def key(*parts: str) -> str:
    """``p1 || ':' || p2 …`` with every part cast to text."""
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


POSTS_EVENT_BODY = """
  SELECT event_id AS post_id, CASE WHEN event_id % 19 = 0 THEN 'other' ELSE event_type END AS grp,
         ts + to_months(CAST(event_id % 12 AS INTEGER)) AS created_at,
         {text} AS text,
         CAST(user_id % 2 AS INTEGER) AS elected,
         CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS incumbent,
         CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_retweet,
         CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS is_quoted,
         CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS is_reply
  FROM events"""

_TAGGED = ("event_type || ' #k' || regexp_extract(props, '([0-9]+)', 1) || ' #u' || "
           "CAST(user_id AS VARCHAR)")
_ELL = "CASE WHEN event_id % 13 = 0 THEN ' …' ELSE '' END"


def posts_event(gaps: bool = False) -> str:
    tagged = _TAGGED
    if gaps:
        tagged = f"CASE WHEN event_id % 17 = 0 THEN event_type ELSE {_TAGGED} END"
    return POSTS_EVENT_BODY.format(text=f"{tagged} || {_ELL}")


EVENT_EMB = """
  SELECT e.event_id AS post_id, m.embedding
  FROM events e JOIN embeddings m
    ON m.vec_id = e.event_id % (SELECT count(*) FROM embeddings)"""

POSTS_DOC = """
  SELECT d.doc_id AS post_id, d.source AS party,
         CASE WHEN d.source IN ('src0', 'src1') THEN 'src0/1' ELSE d.source END AS grp,
         d.text, d.lang, o.o_orderdate AS created_at,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS elected,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS incumbent
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey"""

GROUP_MAP = """
  SELECT g.grp, s.seg FROM
    (SELECT grp, row_number() OVER (ORDER BY grp) AS r
       FROM (SELECT DISTINCT event_type AS grp FROM events)) g
  JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS r
          FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)) s
  ON g.r = s.r"""


def salience_wide() -> tuple[str, str]:
    """SQL of the salience view over ``own``, and of ``own``."""
    brand_cols = []
    for b in range(1, 26):
        share = f"100.0 * coalesce(sum(CASE WHEN brand = {b} THEN q END), 0) / sum(q)"
        if b == 5:
            share = f"CASE WHEN seg <> 'BUILDING' THEN {share} END"
        brand_cols.append(f"{share} AS per{100 + b}")
        if b == 3:
            brand_cols.append("100.0 * coalesce(sum(CASE WHEN brand = 3 THEN q END), 0) / sum(q) "
                              "/ 2.0 AS per103_1")
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    names = ["per201", "per202", "per203", "per305", "per401", "per402", "per403", "per501",
             "per601"]
    type_cols = [f"100.0 * coalesce(sum(CASE WHEN p_type = '{types[i % 6]}' THEN q END), 0) "
                 f"/ sum(q) AS {n}" for i, n in enumerate(names)]
    return f"""
  SELECT * FROM own
  UNION ALL SELECT * REPLACE (199309 AS date, per101 + 1.0 AS per101) FROM own
  UNION ALL SELECT * REPLACE ('Austria' AS countryname, per101 + 1.0 AS per102) FROM own
  UNION ALL SELECT * REPLACE ('UNLISTED' AS partyabbrev) FROM own WHERE partyabbrev = 'BUILDING'""", f"""
  SELECT 199709 AS date, 'Germany' AS countryname, seg AS partyabbrev,
         100.0 * sum(q) / sum(sum(q)) OVER () AS pervote, 0.0 AS peruncod,
         {', '.join(brand_cols)},
         {', '.join(type_cols)}
  FROM (SELECT c.c_mktsegment AS seg,
               CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS INTEGER) AS brand,
               p.p_type, l.l_quantity AS q
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey)
  GROUP BY seg"""


def with_views(sql: str, **views: str) -> str:
    """Prefix a query with ``WITH name AS (body), …``."""
    parts = [f"{name} AS ({body})" for name, body in views.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql


MENTIONS_OF = """
  SELECT post_id, grp, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT post_id, grp, regexp_extract_all(coalesce(text, ''), '{re}') AS t FROM {src})"""


def mentions_of(src: str) -> str:
    return MENTIONS_OF.format(re=TAG_RE, src=src)


# --- vectors, matrices and tests -------------------------------------------------

UNIT_OF = """
  SELECT post_id, list_transform(e, lambda x: x / greatest(nrm, 1e-12)) AS u
  FROM (SELECT post_id, e, sqrt(list_dot_product(e, e)) AS nrm
        FROM (SELECT post_id, CAST(embedding AS DOUBLE[]) AS e FROM {src}))"""


def unit_of(src: str) -> str:
    return UNIT_OF.format(src=src)


def symmetric(cells: str, groups: str, keys: str = "", value: str = "value",
              diag: str = "0.0") -> str:
    """Mirror g1 < g2 cells of ``cells`` and add the diagonal for ``groups`` (grp)."""
    k = f"{keys}, " if keys else ""
    return f"""
  SELECT {k}g1, g2, {value} AS value FROM {cells}
  UNION ALL SELECT {k}g2 AS g1, g1 AS g2, {value} AS value FROM {cells}
  UNION ALL SELECT {k}grp AS g1, grp AS g2, {diag} AS value FROM {groups}"""


def tag_matrix_views(mentions: str, groups: list[str], num_groups: int, threshold: int,
                     keys: str = "", agg: str = "sum") -> dict:
    """Brute-force V3: every pair of mentions of a tag across two groups.

    ``mentions`` has (keys…, post_id, grp, tag, u)."""
    k = f"{keys}, " if keys else ""
    on = " AND ".join([f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(",") if c.strip()]
                      + ["a.tag = b.tag", "a.grp < b.grp"])
    glist = ", ".join(f"'{g}'" for g in groups)
    per = "s" if agg == "sum" else "s / c"
    return {
        "common": f"""SELECT {k}tag FROM {mentions} GROUP BY {k}tag
                      HAVING count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END)
                             >= {num_groups} AND count(*) >= {threshold}""",
        "mu": f"""SELECT m.* FROM {mentions} m SEMI JOIN common USING ({k}tag)
                  WHERE grp IN ({glist})""",
        "complete": f"""SELECT {k}tag FROM mu GROUP BY {k}tag
                        HAVING count(DISTINCT grp) = {len(groups)}""",
        "mc": f"SELECT m.* FROM mu m SEMI JOIN complete USING ({k}tag)",
        "pairs": f"""SELECT {', '.join('a.' + c.strip() for c in keys.split(',') if c.strip()) +
                            ', ' if keys else ''}a.tag, a.grp AS g1, b.grp AS g2,
                            sum(1 - list_dot_product(a.u, b.u)) AS s, count(*) AS c
                     FROM mc a JOIN mc b ON {on} GROUP BY ALL""",
        "cells": f"SELECT {k}g1, g2, avg({per}) AS value FROM pairs GROUP BY {k}g1, g2",
        "xgroups": f"SELECT DISTINCT {k}grp FROM mc",
        "xmat": symmetric("cells", "xgroups", keys),
    }


# the view's columns of each mode, in the view's order, written out
_LATER = "per201 per202 per203 per305 per401 per402 per403 per501 per601".split()
_FIRST = [f"per{100 + b}" for b in range(1, 26)]
SALIENCE_COLS = {
    "full": [*_FIRST[:3], "per103_1", *_FIRST[3:], *_LATER],
    "cat": [*_FIRST, *_LATER],
    "rile": "per103 per104 per105 per106 per107 per201 per202 per203 per305 per401 per402 per403 per601".split(),
    "econ": "per401 per402 per403".split(),
    "galtan": "per201 per202 per305 per501 per601".split(),
}


def salience_cols(mode: str, drop_first: bool = True) -> list[str]:
    return SALIENCE_COLS[mode][1:] if drop_first else SALIENCE_COLS[mode]


def salience_matrix_views(mode: str, drop_first: bool, mapped: bool) -> dict:
    """V7 over the salience view; ``mapped`` renames segments to event groups."""
    cols = salience_cols(mode, drop_first)
    grp = "gm.grp" if mapped else "s.partyabbrev"
    join = "JOIN group_map gm ON gm.seg = s.partyabbrev" if mapped else ""
    unions = "\n  UNION ALL ".join(
        f"SELECT {grp} AS grp, '{c}' AS category, coalesce(CAST(s.{c} AS DOUBLE), 0.0) AS v "
        f"FROM salience s {join} WHERE CAST(s.date AS VARCHAR) LIKE '1997%' "
        f"AND s.countryname = 'Germany' AND s.partyabbrev <> 'UNLISTED'" for c in cols)
    view, own = salience_wide()
    return {
        "own": own,
        "salience": view,
        "group_map": GROUP_MAP,
        "slong": unions,
        "scells": """SELECT a.grp AS g1, b.grp AS g2, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS value
                     FROM slong a JOIN slong b ON a.category = b.category AND a.grp < b.grp
                     GROUP BY a.grp, b.grp""",
        "sgroups": "SELECT DISTINCT grp FROM slong",
        "ymat": symmetric("scells", "sgroups"),
    }


def mantel_views(groups: list[str], keys: str = "", methods=("pearson", "spearman")) -> dict:
    """Exhaustive Mantel test of xmat (keys…, g1, g2, value) against ymat (g1, g2, value)."""
    n = len(groups)
    k = f"{keys}, " if keys else ""
    idx = " UNION ALL ".join(f"SELECT '{g}' AS g, {i} AS i" for i, g in enumerate(groups))
    pcols = ", ".join(f"t{i}.i AS p{i}" for i in range(n))
    pfrom = ", ".join(f"gi t{i}" for i in range(n))
    pwhere = " AND ".join(f"t{i}.i <> t{j}.i" for i in range(n) for j in range(i + 1, n))
    ident = " AND ".join(f"p{i} = {i}" for i in range(n))

    def pick(c):
        return "CASE " + " ".join(f"WHEN {c} = {i} THEN p{i}" for i in range(n)) + " END"

    views = {
        "gi": idx,
        "perms": f"SELECT {pcols}, CASE WHEN {ident} THEN 1 ELSE 0 END AS ident "
                 f"FROM {pfrom} WHERE {pwhere}",
        "xc": f"""SELECT {k}a.i AS i, b.i AS j, CAST(x.value AS DOUBLE) AS x FROM xmat x
                  JOIN gi a ON a.g = x.g1 JOIN gi b ON b.g = x.g2 WHERE a.i < b.i""",
        "yc": """SELECT a.i AS i, b.i AS j, CAST(y.value AS DOUBLE) AS y FROM ymat y
                 JOIN gi a ON a.g = y.g1 JOIN gi b ON b.g = y.g2 WHERE a.i < b.i""",
    }
    part = f"PARTITION BY {keys}" if keys else ""
    part2 = f"PARTITION BY {k}round(x, 10)"
    views["xr"] = f"""SELECT {k}i, j, rank() OVER ({part} ORDER BY round(x, 10))
                        + (count(*) OVER ({part2}) - 1) / 2.0 AS x FROM xc"""
    views["yr"] = """SELECT i, j, rank() OVER (ORDER BY round(y, 10))
                       + (count(*) OVER (PARTITION BY round(y, 10)) - 1) / 2.0 AS y FROM yc"""
    selects = []
    for m in methods:
        xs, ys = ("xc", "yc") if m == "pearson" else ("xr", "yr")
        views[f"rs_{m}"] = f"""
          SELECT {k}pid, ident, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r
          FROM (SELECT {k}p.pid, p.ident, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy,
                       sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy
                FROM {xs} x, (SELECT row_number() OVER () AS pid, * FROM perms) p
                JOIN {ys} y ON y.i = least({pick('x.i')}, {pick('x.j')})
                           AND y.j = greatest({pick('x.i')}, {pick('x.j')})
                GROUP BY ALL)"""
        join_on = f"USING ({keys})" if keys else "ON TRUE"
        selects.append(f"""
          SELECT {k}'{m}' AS method, max(o.r_obs) AS r,
                 avg(CASE WHEN abs(round(r, 12)) >= abs(round(o.r_obs, 12)) THEN 1.0 ELSE 0.0 END) AS p,
                 (max(o.r_obs) - avg(r)) / stddev_pop(r) AS z, CAST(count(*) AS BIGINT) AS n_perm,
                 TRUE AS method_exact
          FROM rs_{m} JOIN (SELECT {k}r AS r_obs FROM rs_{m} WHERE ident = 1) o {join_on}
          GROUP BY {keys if keys else 'ALL'}""")
    views["mres"] = " UNION ALL ".join(selects)
    assert math.factorial(n) > 0
    return views


def config_values(configs) -> str:
    rows = ", ".join(f"({i}, '{c.mode}', {c.seed}, CAST({float(c.fraction)} AS DOUBLE), "
                     f"{c.month_start}, {c.month_end})" for i, c in enumerate(configs))
    return (f"SELECT * FROM (VALUES {rows}) AS t(config, mode, seed, fraction, month_start, "
            "month_end)")


MARKER = """CASE WHEN mode = 'full' THEN 'full'
     WHEN mode = 'random' THEN 'random-seed' || CAST(seed AS VARCHAR) || '-' || CAST(fraction AS VARCHAR)
     WHEN mode = 'time' THEN 'time-(' || CAST(month_start AS VARCHAR) || ', ' || CAST(month_end AS VARCHAR) || ')'
     ELSE mode END"""


def experiment_views(configs, groups, num_groups, threshold) -> dict:
    """Per-configuration posts by explicit predicates, then brute-force V3 and Mantel."""
    member = f"""
  SELECT c.config, p.post_id, p.grp, p.text FROM posts_event p JOIN cfg c ON
     (c.mode = 'full')
  OR (c.mode = 'random' AND {h32(key('c.seed', 'p.post_id'))} < c.fraction * 4294967296)
  OR (c.mode = 'time' AND month(p.created_at) BETWEEN c.month_start AND c.month_end)
  OR (c.mode = 'elected' AND p.elected = 1)
  OR (c.mode = 'incumbent' AND p.incumbent = 1)
  OR (c.mode = 'reelected' AND p.elected = 1 AND p.incumbent = 1)
  OR (c.mode = 'newly_elected' AND p.elected = 1 AND p.incumbent = 0)
  OR (c.mode = 'not_reelected' AND p.elected = 0 AND p.incumbent = 1)
  OR (c.mode = 'content' AND p.is_retweet = 0 AND p.is_quoted = 0 AND p.is_reply = 0
      AND NOT ends_with(p.text, '…'))"""
    views = {
        "posts_event": posts_event(), "emb": EVENT_EMB, "eu": unit_of("emb"),
        "cfg": config_values(configs), "member": member,
        "cm0": f"""SELECT config, post_id, grp, unnest(regexp_extract_all(coalesce(text, ''), '{TAG_RE}')) AS tag
                   FROM member""",
        "cm": "SELECT m.*, eu.u FROM cm0 m JOIN eu USING (post_id)",
    }
    views.update(tag_matrix_views("cm", groups, num_groups, threshold, keys="config"))
    views.update(salience_matrix_views("full", True, mapped=True))
    views.update(mantel_views(groups, keys="config"))
    return views


def experiment_sql(configs, groups, num_groups, threshold) -> str:
    v = experiment_views(configs, groups, num_groups, threshold)
    return with_views(f"""
  SELECT cfg.config, {MARKER} AS marker, a.method, round(m.r, 6) AS r, round(m.p, 6) AS p,
         round(m.z, 6) AS z, CAST({math.factorial(len(groups))} AS BIGINT) AS n_perm,
         CAST(coalesce(t.n_tags, 0) AS BIGINT) AS n_tags
  FROM cfg, (SELECT unnest(['pearson', 'spearman']) AS method) a
  LEFT JOIN mres m ON m.config = cfg.config AND m.method = a.method
  LEFT JOIN (SELECT config, count(*) AS n_tags FROM complete GROUP BY config) t
    ON t.config = cfg.config""", **v)


def results_sql(configs, groups, num_groups, threshold, model: str, year: int, evaluation: str) -> str:
    """The kept form of the results: one row per run."""
    cols = ", ".join(f"max(CASE WHEN method = '{m}' THEN {c} END) AS {c}_{m}"
                     for m in ("pearson", "spearman") for c in ("r", "p", "z"))
    return f"""SELECT '{model}' AS model, CAST({year} AS INTEGER) AS year, marker AS mode,
                      '{evaluation}' AS eval, {cols}
               FROM ({experiment_sql(configs, groups, num_groups, threshold)}) GROUP BY marker"""


CLUSTERED = """
  SELECT a.vec_id AS post_id, CAST(a.label AS VARCHAR) AS grp,
         CASE WHEN a.vec_id % 97 = 96 THEN list_transform(a.embedding, lambda x: CAST(0 AS DOUBLE))
              ELSE list_transform(list_zip(c.embedding, a.embedding),
                                  lambda z: CAST(z[1] AS DOUBLE) * 6 + CAST(z[2] AS DOUBLE)) END AS embedding
  FROM embeddings a JOIN embeddings c
    ON c.vec_id = a.vec_id % (SELECT greatest(25, count(*) // 20) FROM embeddings)"""


def twin_views(raw: str = "SELECT vec_id AS post_id, CAST(label AS VARCHAR) AS grp, embedding FROM embeddings") -> dict:
    """Brute-force twin matching over the labelled embeddings (label = group)."""
    return {
        "lvraw": raw,
        "lvu": unit_of("lvraw"),
        "v": "SELECT r.post_id AS id, r.grp, u.u FROM lvraw r JOIN lvu u USING (post_id)",
        "sims": """SELECT a.id AS a_id, a.grp AS ga, b.id AS b_id, b.grp AS gb,
                          list_dot_product(a.u, b.u) AS s FROM v a, v b""",
        "mx": "SELECT a_id, ga, gb, max(s) AS best FROM sims GROUP BY ALL",
        "tw": """SELECT m.a_id, m.ga, m.gb, m.best, min(s.b_id) AS t_id FROM mx m
                 JOIN sims s ON s.a_id = m.a_id AND s.gb = m.gb AND s.s = m.best GROUP BY ALL""",
        "cc": """SELECT a_id, greatest(0.0, coalesce(max(s) FILTER (WHERE b_id <> a_id AND gb = ga), 0.0)) AS c
                 FROM sims GROUP BY a_id""",
        "sim": """SELECT tw.ga AS g1, tw.gb AS g2,
                         CASE WHEN count(*) = count(nullif(ca.c + ct.c, 0))
                              THEN avg(tw.best / nullif(ca.c + ct.c, 0)) END AS value
                  FROM tw JOIN cc ca ON ca.a_id = tw.a_id JOIN cc ct ON ct.a_id = tw.t_id GROUP BY ALL""",
        "sim1": "SELECT g1, g2, CASE WHEN g1 = g2 THEN 1.0 ELSE value END AS value FROM sim",
        "dist": """SELECT a.g1, a.g2, 1.0 - (a.value + b.value) / 2.0 AS value FROM sim1 a
                   JOIN sim1 b ON a.g1 = b.g2 AND a.g2 = b.g1""",
    }


def pair_views(num_groups: int, threshold: int, seed: int, n_samples: int, k: int = 100,
               hot: bool = False, heavy: int = 0) -> dict:
    """Pair generator by full joins: anti join for clean posts, row_number for samples."""
    s = str(seed)
    posts = posts_event()
    if heavy:
        own = " || ".join(f"CASE WHEN CAST(floor(post_id * {2 * j + 3} / {j + 1}) AS BIGINT) % 10 < 3 THEN ' #heavy{j}' ELSE '' END"
                          for j in range(heavy))
        posts = f"SELECT * REPLACE (text || {own} AS text) FROM ({posts})"
    if hot:
        posts = f"""SELECT * REPLACE (CASE WHEN post_id % 10 = 0 THEN text ELSE text || ' #all' END AS text)
                    FROM ({posts})"""
    return {
        "posts_event": posts,
        "tp": f"""SELECT * FROM (SELECT post_id, grp, text,
                      regexp_extract_all(coalesce(text, ''), '{TAG_RE}') AS tags FROM posts_event)
                  WHERE len(tags) > 0""",
        "ments": "SELECT post_id, grp, unnest(tags) AS tag FROM tp",
        "common": f"""SELECT tag FROM ments GROUP BY tag
                      HAVING count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END)
                             >= {num_groups} AND count(*) >= {threshold}""",
        "tpost": "SELECT DISTINCT tag, post_id FROM ments",
        "cooc": """SELECT DISTINCT a.tag, b.tag AS other FROM ments a JOIN ments b USING (post_id)
                   WHERE a.tag IN (SELECT tag FROM common)""",
        "pos1": f"""SELECT * FROM (SELECT tag, post_id, row_number() OVER (PARTITION BY tag
                      ORDER BY md5({key(s, "'pos'", 'tag', 'post_id')})) AS rnk
                    FROM tpost WHERE tag IN (SELECT tag FROM common)) WHERE rnk <= {k}""",
        "pos2": f"""SELECT * FROM (SELECT tag, post_id, row_number() OVER (PARTITION BY tag
                      ORDER BY md5({key(s, "'pos2'", 'tag', 'post_id')})) AS rnk
                    FROM tpost WHERE tag IN (SELECT tag FROM common)) WHERE rnk <= {k}""",
        "pp": f"""SELECT tag, id1, id2 FROM (
                    SELECT a.tag, a.post_id AS id1, b.post_id AS id2, row_number() OVER (
                      PARTITION BY a.tag ORDER BY md5({key(s, "'pp'", 'a.tag', 'a.post_id', 'b.post_id')})) AS rnk
                    FROM pos1 a JOIN pos1 b ON a.tag = b.tag AND a.rnk < b.rnk)
                  WHERE rnk <= {n_samples}""",
        "cand": "SELECT c.tag, p.post_id, p.tags FROM common c, tp p",
        "dirty": """SELECT DISTINCT x.tag, x.post_id FROM
                      (SELECT tag, post_id, unnest(tags) AS other FROM cand) x
                    JOIN cooc USING (tag, other)""",
        "neg": f"""SELECT tag, post_id FROM (
                     SELECT c.tag, c.post_id, row_number() OVER (PARTITION BY c.tag ORDER BY
                       ((({h32(key(s, 'c.post_id'))}) - ({h32(key(s, 'c.tag'))})) % 4294967296
                          + 4294967296) % 4294967296, c.post_id) AS rnk
                     FROM cand c ANTI JOIN dirty d ON c.tag = d.tag AND c.post_id = d.post_id)
                   WHERE rnk <= {k}""",
        "np": f"""SELECT tag, id1, id2 FROM (
                    SELECT a.tag, a.post_id AS id1, b.post_id AS id2, row_number() OVER (
                      PARTITION BY a.tag ORDER BY md5({key(s, "'np'", 'a.tag', 'a.post_id', 'b.post_id')})) AS rnk
                    FROM pos2 a JOIN neg b ON a.tag = b.tag)
                  WHERE rnk <= {n_samples}""",
        "pairs": """SELECT x.tag, x.id1, x.id2, t1.text AS sent1, t2.text AS sent2, x.label FROM
                      (SELECT tag, id1, id2, 1 AS label FROM pp
                       UNION ALL SELECT tag, id1, id2, 0 AS label FROM np) x
                    JOIN tp t1 ON t1.post_id = x.id1 JOIN tp t2 ON t2.post_id = x.id2""",
        "ranked": f"""SELECT *, row_number() OVER (ORDER BY
                        md5({key(s, "'split'", 'tag', 'id1', 'id2', 'label')})) AS rnk,
                        count(*) OVER () AS n FROM pairs""",
        "split_texts": """SELECT sent1, sent2, label,
                           CASE WHEN rnk <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split
                    FROM ranked""",
        "split": """SELECT tag, id1, id2, label,
                           CASE WHEN rnk <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split
                    FROM ranked""",
    }


def eval_views() -> dict:
    """Pair scores of consecutive embeddings and their correlations with the label."""
    m = ["cosine", "manhattan", "euclidean", "dot"]
    ranks = " UNION ALL ".join(
        f"""SELECT '{x}' AS metric, label,
              rank() OVER (ORDER BY round({x}, 10)) + (count(*) OVER (PARTITION BY round({x}, 10)) - 1) / 2.0 AS rs,
              rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl,
              {x} AS score FROM scores""" for x in m)
    return {
        "ev": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
        "lp": """SELECT a.vec_id AS id1, b.vec_id AS id2,
                        CAST(CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS DOUBLE) AS label
                 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "scores": """SELECT lp.label,
                       coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 0.0) AS cosine,
                       -list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))) AS manhattan,
                       -sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS euclidean,
                       list_dot_product(a.e, b.e) AS dot
                     FROM lp JOIN ev a ON a.id = lp.id1 JOIN ev b ON b.id = lp.id2""",
        "rk": ranks,
        "res": """SELECT metric, corr(label, score) AS pearson, corr(rl, rs) AS spearman,
                         count(*) AS n_pairs, count(score) AS n_scored
                  FROM rk GROUP BY metric""",
    }


# posts_doc of which some texts are empty and some NULL
BLANK = """SELECT * REPLACE (CASE WHEN post_id % 50 = 0 THEN '' WHEN post_id % 50 = 1 THEN NULL
                             ELSE text END AS text) FROM posts_all"""


def weighted_sum(v: str, power: int = 1, dim: int = 64) -> str:
    """Sum of i**power * v[i]: a number that changes when elements change places."""
    return f"list_dot_product({v}, [CAST(i ** {power} AS DOUBLE) for i in range(1, {dim + 1})])"


def doc_token_views(year: int | None = None, blanks: bool = False) -> dict:
    tok = r"[^ \t\n\x0B\f\r]+"
    where = "" if year is None else f" WHERE year(o.o_orderdate) = {int(year)}"
    return ({"posts_all": POSTS_DOC + where, "posts_doc": BLANK} if blanks else {"posts_doc": POSTS_DOC + where}) | {
        "toks": f"""SELECT post_id, unnest(regexp_extract_all(replace(text, chr(10), ' '), '{tok}')) AS tok
                    FROM posts_doc""",
        "th": f"SELECT post_id, tok, {h32('tok')} AS h FROM toks",
    }


def evaluate_job_views() -> dict:
    """Validation pairs of the pair generator → hashed 32-dim text vectors → M3."""
    tok = r"[^ \t\n\x0B\f\r]+"
    v = dict(pair_views(5, 10, 42, 230))
    m = ["cosine", "manhattan", "euclidean", "dot"]
    v.update({
        "val": "SELECT sent1, sent2, CAST(label AS DOUBLE) AS label FROM split_texts WHERE split = 'val'",
        "texts": "SELECT DISTINCT t FROM (SELECT sent1 AS t FROM val UNION ALL SELECT sent2 FROM val)",
        "ttoks": f"SELECT t, unnest(regexp_extract_all(replace(t, chr(10), ' '), '{tok}')) AS tok FROM texts",
        "tcells": f"""SELECT t, h % 32 AS b, sum(CASE WHEN h < 2147483648 THEN 1.0 ELSE -1.0 END) AS v
                      FROM (SELECT t, {h32('tok')} AS h FROM ttoks) GROUP BY ALL""",
        "tnorm": "SELECT t, sqrt(sum(v * v)) AS nrm FROM tcells GROUP BY t",
        "tgrid": "SELECT t, range AS b FROM texts, range(32)",
        "tvec": """SELECT g.t, list(CASE WHEN n.nrm > 0 THEN coalesce(c.v, 0.0) / n.nrm ELSE 0.0 END
                                ORDER BY g.b) AS e
                   FROM tgrid g LEFT JOIN tcells c ON c.t = g.t AND c.b = g.b
                   LEFT JOIN tnorm n ON n.t = g.t GROUP BY g.t""",
        "scores": """SELECT val.label,
                       coalesce(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 0.0) AS cosine,
                       -list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))) AS manhattan,
                       -sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS euclidean,
                       list_dot_product(a.e, b.e) AS dot
                     FROM val JOIN tvec a ON a.t = val.sent1 JOIN tvec b ON b.t = val.sent2""",
        "rk": " UNION ALL ".join(
            f"""SELECT '{x}' AS metric, label,
                  rank() OVER (ORDER BY round({x}, 10)) + (count(*) OVER (PARTITION BY round({x}, 10)) - 1) / 2.0 AS rs,
                  rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl,
                  {x} AS score FROM scores""" for x in m),
        "res": """SELECT metric, corr(label, score) AS pearson, corr(rl, rs) AS spearman,
                         count(*) AS n_pairs, count(score) AS n_scored
                  FROM rk GROUP BY metric""",
    })
    return v
