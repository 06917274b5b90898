"""DuckDB SQL with the result of each query that plain SQL can express.

``_sql(body, ...)`` puts the named common tables in front of a body. Fractions are rounded to 6 places, whole numbers are
BIGINT, as the queries return them.
"""

from __future__ import annotations

# Seeded keys: md5 of the row's own columns and the seed, and the uniform number its first 13 digits make.
_KEY = "md5({0} || '|42')"
_U01 = "(('0x' || substr(md5({0} || '|42'), 1, 13))::BIGINT / 4503599627370496.0)"

_PAIR = _U01.format("(user_id || '|' || item_id)")

_TABLES = {
    "purchases": """SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE,
        round(l_extendedprice * 100)::BIGINT) AS row_id, o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id,
        o_orderdate AS timestamp, l_suppkey::VARCHAR AS provider FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clicks": """SELECT event_id::VARCHAR AS row_id, user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS item_id,
        ts AS timestamp, value FROM events""",
    "items": """SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_brand AS tag, p_type AS category, p_size AS size,
        p_retailprice AS price FROM part""",
    "users": "SELECT c_custkey::VARCHAR AS user_id, c_mktsegment AS \"group\", c_nationkey AS nation FROM customer",
    "vectors": "SELECT vec_id::VARCHAR AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings",
    # activity filter at 40 rows a user and 30 an item
    "active_items": "SELECT * FROM purchases WHERE item_id IN (SELECT item_id FROM purchases GROUP BY 1 HAVING count(*) >= 30)",
    "active": "SELECT * FROM active_items WHERE user_id IN (SELECT user_id FROM active_items GROUP BY 1 HAVING count(*) >= 40)",
    # purchases split in time, popular unseen items for the users of the later part
    "halves": f"""SELECT *, row_number() OVER (ORDER BY timestamp, {_KEY.format('row_id')})
        <= floor(count(*) OVER () * 0.8::DOUBLE) AS early FROM purchases""",
    "history": "SELECT * FROM halves WHERE early",
    "test": "SELECT * FROM halves WHERE NOT early",
    "scored": """SELECT item_id, coalesce(c, 0) AS pop, coalesce(c, 0) / greatest(max(coalesce(c, 0)) OVER (), 1) AS score
        FROM items LEFT JOIN (SELECT item_id, count(*) AS c FROM purchases GROUP BY 1) USING (item_id)""",
    "open": """SELECT u.user_id, s.item_id, s.pop, s.score FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN scored s
        ANTI JOIN (SELECT DISTINCT user_id, item_id FROM history) h ON h.user_id = u.user_id AND h.item_id = s.item_id""",
    "recs": """SELECT user_id, item_id, round(score, 9) AS score,
        row_number() OVER (PARTITION BY user_id ORDER BY pop DESC, item_id) AS rank FROM open QUALIFY rank <= 10""",
    "relevant": "SELECT user_id, item_id, count(*) AS n_rows FROM test GROUP BY ALL",
    "hits": """SELECT t.user_id, t.n_rel, r.rank, row_number() OVER (PARTITION BY t.user_id ORDER BY r.rank) AS place
        FROM (SELECT user_id, count(*) AS n_rel FROM relevant GROUP BY 1) t LEFT JOIN
        (SELECT recs.user_id, rank FROM recs JOIN relevant USING (user_id, item_id)) r ON r.user_id = t.user_id""",
    # popularity ranks of the history and the measures of each recommended item
    "ranks": """SELECT item_id, count(*) AS pop, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 AS pop_rank
        FROM history GROUP BY 1""",
    "novel": """SELECT r.user_id, r.item_id, -log2(greatest(k.pop / (SELECT sum(pop) FROM ranks), 1e-10)) AS info,
        ln((SELECT count(DISTINCT user_id) FROM history) / (k.pop + 1e-10)) AS iif, (SELECT count(*) FROM ranks) AS n_items,
        coalesce(k.pop_rank, (SELECT count(*) FROM ranks))::DOUBLE AS pop_rank,
        CASE WHEN k.pop_rank >= floor((SELECT count(*) FROM ranks) * 0.2) THEN 1.0 ELSE 0.0 END AS tail,
        CASE WHEN h.user_id IS NULL THEN 1.0 ELSE 0.0 END AS fresh
        FROM recs r LEFT JOIN ranks k USING (item_id)
        LEFT JOIN (SELECT DISTINCT user_id, item_id FROM history) h ON h.user_id = r.user_id AND h.item_id = r.item_id""",
    "providers": """SELECT item_id, arg_max(provider, {'c': c, 'p': provider}) AS provider FROM (SELECT item_id, provider,
        count(*) AS c FROM purchases GROUP BY ALL) GROUP BY item_id""",
    "exposed": """SELECT coalesce(provider, 'unknown') AS provider, count(*) AS c FROM recs LEFT JOIN providers USING (item_id)
        GROUP BY 1""",
    # the same halves of the clicks; the model's rows are those of catalog items
    "click_halves": f"""SELECT *, row_number() OVER (ORDER BY timestamp, {_KEY.format('row_id')})
        <= floor(count(*) OVER () * 0.8::DOUBLE) AS early FROM clicks""",
    "click_history": "SELECT * FROM click_halves WHERE early",
    "click_test": "SELECT * FROM click_halves WHERE NOT early",
    "click_seen": "SELECT DISTINCT user_id, item_id FROM click_history",
    "click_model": "SELECT * FROM click_history SEMI JOIN items USING (item_id)",
    "click_users": "SELECT DISTINCT user_id FROM click_test UNION ALL SELECT 'no-user'",
    "click_pairs": """SELECT DISTINCT user_id, item_id FROM click_test UNION ALL SELECT min(user_id), 'no-item' FROM click_test
        UNION ALL SELECT 'no-user', min(item_id) FROM click_test""",
    "click_pop": """SELECT item_id, coalesce(c, 0) AS pop, round(coalesce(c, 0) / greatest(max(coalesce(c, 0)) OVER (), 1), 9) AS score
        FROM items LEFT JOIN (SELECT item_id, count(*) AS c FROM clicks GROUP BY 1) USING (item_id)""",
    "taste": """SELECT user_id, list(x ORDER BY i) AS t FROM (SELECT user_id, i, avg(v[i]) AS x FROM click_seen JOIN vectors
        USING (item_id), range(1, 65) r(i) GROUP BY ALL) GROUP BY 1""",
    # one or two files per part; the first accepted ending of each item
    "listing": """SELECT 'file:/images/' || p_partkey || e AS path, p_partkey::VARCHAR AS item_id, e AS ext,
        (p_size * 40000)::BIGINT AS length, CASE WHEN p_size % 11 = 0 THEN -1 ELSE p_size * 60 END AS width,
        CASE WHEN p_size % 11 = 0 THEN -1 ELSE p_size * 35 END AS height FROM (SELECT *, unnest(CASE WHEN p_size % 7 = 0
        THEN ['.gif'] WHEN p_size % 3 = 0 THEN ['.png', '.jpg'] ELSE ['.jpeg'] END) AS e FROM part)""",
    "found": """SELECT * FROM listing WHERE ext IN ('.jpg', '.jpeg', '.png') QUALIFY row_number() OVER (PARTITION BY item_id
        ORDER BY list_position(['.jpg', '.jpeg', '.png'], ext), path) = 1""",
    "valid": "SELECT item_id FROM found WHERE width >= 200 AND height >= 200",
    "matrix": "SELECT user_id, item_id, count(*) AS c FROM {source} GROUP BY ALL",
    "labelled": f"SELECT doc_id, quality AS label, {_U01.format('doc_id::VARCHAR')} AS score FROM labels",
}
_NEEDS = {
    "active_items": ("purchases",), "active": ("active_items",), "halves": ("purchases",), "history": ("halves",),
    "test": ("halves",), "scored": ("items", "purchases"), "open": ("test", "history", "scored"), "recs": ("open",),
    "relevant": ("test",), "hits": ("relevant", "recs"), "ranks": ("history",), "novel": ("recs", "ranks", "history"),
    "click_halves": ("clicks",), "click_history": ("click_halves",), "click_test": ("click_halves",), "click_seen": ("click_history",),
    "click_model": ("click_history", "items"), "click_users": ("click_test",), "click_pairs": ("click_test",),
    "click_pop": ("items", "clicks"), "taste": ("click_seen", "vectors"),
    "found": ("listing",), "valid": ("found",),
    "providers": ("purchases",), "exposed": ("recs", "providers"),
}


def _sql(body: str, *names: str, **own: str) -> str:
    """``body`` behind the tables it needs; ``own`` adds tables for this query only."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    tables = [f"{n} AS ({_TABLES[n]})" for n in order] + [f"{n} AS ({t})" for n, t in own.items()]
    return ("WITH " + ",\n".join(tables) + "\n" if tables else "") + body


def _shared(strata: str, count: str, total: str, out: str) -> str:
    """Largest remainders: ``total`` over the strata in proportion to ``count``."""
    units = f"{count}::HUGEINT * ({total})::HUGEINT"
    return f"""SELECT * EXCLUDE (f, p), (f + CASE WHEN p <= ({total}) - (sum(f) OVER ()) THEN 1 ELSE 0 END)::BIGINT AS {out}
        FROM (SELECT *, f_ AS f, row_number() OVER (ORDER BY r_ DESC, stratum) AS p FROM (SELECT *,
        ({units} // sum({count}) OVER ())::BIGINT AS f_, ({units} % sum({count}) OVER ())::BIGINT AS r_ FROM {strata}))"""


def _column_split(source: str) -> dict[str, str]:
    return {
        "s": f"SELECT p.row_id, coalesce(i.tag, '') AS stratum FROM {source} p LEFT JOIN items i USING (item_id)",
        "n0": "SELECT stratum, count(*) AS c FROM s GROUP BY 1",
        "n1": _shared("n0", "c", "(SELECT count(*) - ceil(count(*) * 0.7::DOUBLE) FROM s)", "n_front"),
        "n2": _shared("(SELECT stratum, n_front FROM n1)", "n_front",
                      "(SELECT sum(n_front) - ceil(sum(n_front) * 0.5::DOUBLE) FROM n1)", "n_middle"),
        "labelled_rows": f"""SELECT row_id, CASE WHEN rn <= n_middle THEN 'val' WHEN rn <= n_front THEN 'test' ELSE 'train' END
            AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_KEY.format('row_id')}, row_id) AS rn
            FROM s) JOIN (SELECT stratum, n_front, n_middle FROM n2) USING (stratum)""",
    }


def _temporal_strata() -> dict[str, str]:
    return {
        "ordered": f"""SELECT *, row_number() OVER (ORDER BY timestamp, {_KEY.format('row_id')})
            <= floor(count(*) OVER () * 0.7::DOUBLE) AS early FROM purchases""",
        "later": """SELECT o.*, coalesce(i.tag, '') AS stratum FROM ordered o LEFT JOIN items i USING (item_id)
            WHERE NOT early AND user_id IN (SELECT user_id FROM ordered WHERE early)""",
        "n0": "SELECT stratum, count(*) AS c FROM later GROUP BY 1",
        "n1": _shared("n0", "c", "(SELECT count(*) - ceil(count(*) * 0.5::DOUBLE) FROM later)", "n_front"),
        "done": f"""SELECT row_id, user_id, item_id, timestamp, 'train' AS split FROM ordered WHERE early UNION ALL
            SELECT row_id, user_id, item_id, timestamp, CASE WHEN rn <= n_front THEN 'val' ELSE 'test' END FROM
            (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_KEY.format('row_id')}, row_id) AS rn FROM later)
            JOIN (SELECT stratum, n_front FROM n1) USING (stratum)""",
    }


def _subsets(source: str) -> dict[str, str]:
    out = {
        "t": f"SELECT row_id, timestamp, epoch_us(timestamp::TIMESTAMP) AS us FROM {source}",
        "e": "SELECT list_distinct(quantile_cont(us, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM t",
        "b": "SELECT t.*, lpad(len(list_filter(edges, lambda x: x < us))::VARCHAR, 3, '0') AS stratum FROM t, e",
        "q0": "SELECT stratum, count(*) AS c0 FROM b GROUP BY 1",
    }
    kept = "count(*)"
    for i, fraction in enumerate((0.5, 0.4, 0.25)):
        size, kept = kept, f"ceil(({kept}) * {fraction}::DOUBLE)"
        left = _shared(f"(SELECT stratum, c{i}{''.join(f', c{j}' for j in range(i))} FROM q{i})", f"c{i}",
                       f"(SELECT {size} - {kept} FROM b)", "gone")
        columns = "".join(f", c{j}" for j in range(i + 1))
        out[f"q{i + 1}"] = f"SELECT stratum{columns}, c{i} - gone AS c{i + 1} FROM ({left})"
    out["levels"] = f"""SELECT row_id, timestamp, stratum AS time_bin,
        ((rn <= c1)::BIGINT + (rn <= c2)::BIGINT + (rn <= c3)::BIGINT) AS level
        FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_KEY.format('row_id')}, row_id) AS rn FROM b)
        JOIN q3 USING (stratum)"""
    return out


def _cosines(source: str, a: str, via: str) -> dict[str, str]:
    return {
        "m": f"SELECT {a} AS a, {via} AS k, count(*) AS c FROM {source} GROUP BY ALL",
        "sq": "SELECT a, sqrt(sum(c * c)) AS n FROM m GROUP BY 1",
        "sim": """SELECT x.a AS a, y.a AS b, sum(x.c * y.c) / (any_value(p.n) * any_value(q.n)) AS sim FROM m x JOIN m y USING (k)
            JOIN sq p ON p.a = x.a JOIN sq q ON q.a = y.a GROUP BY x.a, y.a""",
    }


def _grid(n: str) -> str:
    """Columns of the nearly square grid with room for n cells and as few others as possible."""
    q = f"ceil(sqrt({n}))::BIGINT"
    return f"list_min(list_transform(range({q}, 2 * {q} + 1), lambda s: (({n} + s - 1) // s) * s * 1000000 + s)) % 1000000"


def _scattered(source: str, keys: str) -> dict[str, str]:
    """Steps of ``source`` (user_id, rows, columns, step, k1, k2) with their place: four rounds of a Feistel network."""
    out, before = {}, f"(SELECT *, step // columns AS a, step % columns AS b FROM ({source}))"
    for i in range(4):
        digits = lambda start: f"('0x' || substr(k{1 + i // 2}, {start}, 8))::BIGINT % 2147483647"
        y = f"({digits(1 + 16 * (i % 2))} + {digits(9 + 16 * (i % 2))} * {'a' if i % 2 else 'b'}) % 2147483647"
        cube = "((y * y) % 2147483647 * y) % 2147483647"
        moved = f"a, (b + {cube}) % columns AS b" if i % 2 else f"(a + {cube}) % rows AS a, b"
        out[f"{keys}{i}"] = f"SELECT * EXCLUDE (a, b, y), {moved} FROM (SELECT *, {y} AS y FROM {before})"
        before = f"{keys}{i}"
    return out


def _turn(key: str) -> str:
    """The two keys of a permutation."""
    longer = f"({key} || '|turn')"
    return f"{_KEY.format(key)} AS k1, {_KEY.format(longer)} AS k2"


def _walk(need: str, excluded: str) -> dict[str, str]:
    """Uniform draws: per (user_id, m) the first m catalog items, in the user's permutation, that aren't excluded."""
    return {
        "cat": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM (SELECT DISTINCT item_id FROM items)",
        "need": need, "excluded": excluded,
        "grids": f"SELECT (n + columns - 1) // columns AS rows, columns FROM (SELECT n, {_grid('n')} AS columns FROM (SELECT count(*) AS n FROM cat))",
        **_scattered(f"SELECT user_id, m, rows, columns, unnest(range(0, rows * columns)) AS step, {_turn('user_id')} FROM need, grids", "w"),
        "drawn": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY step) AS rank
            FROM (SELECT user_id, m, step, a * columns + b AS pos FROM w3) JOIN cat USING (pos)
            ANTI JOIN excluded USING (user_id, item_id) QUALIFY rank <= m""",
    }


def _arrive(need: str, excluded: str, weights: str) -> dict[str, str]:
    """Weighted draws: per (user_id, m) the first m arrivals; waits come class by class at the top rate, in the user's permutation."""
    wait = lambda key, start: f"-ln((('0x' || substr({key}, {start}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0)"
    pair, at = _KEY.format("(user_id || '|' || item_id)"), _KEY.format("(user_id || '|' || c || '|' || step)")
    return {
        "cat": "SELECT DISTINCT item_id FROM items", "excluded": excluded, "need": need, "weights": weights,
        "weighed": """SELECT *, row_number() OVER (PARTITION BY c ORDER BY item_id) - 1 AS spot FROM (SELECT item_id, coalesce(w, 0) AS w,
            CASE WHEN w > 0 THEN floor(log2(w) + 1e-9)::BIGINT ELSE -1048576 END AS c FROM cat LEFT JOIN weights USING (item_id))""",
        "grids": f"""SELECT *, (n + columns - 1) // columns AS rows FROM (SELECT c, n, top, {_grid('n')} AS columns
            FROM (SELECT c, count(*) AS n, max(w) AS top FROM weighed GROUP BY 1))""",
        **_scattered(f"""SELECT user_id, m, c, n, top, rows, columns, unnest(range(0, rows * columns)) AS step,
            {_turn("(user_id || '|' || c)")} FROM need, grids WHERE m > 0""", "w"),
        "ordered": """SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY step) AS j
            FROM (SELECT *, a * columns + b AS spot FROM w3) WHERE spot < n""",
        "waits": f"""SELECT *, sum(gap) OVER (PARTITION BY user_id, c ORDER BY step ROWS UNBOUNDED PRECEDING) AS wait FROM (SELECT *,
            CASE WHEN c = -1048576 THEN 1.0 ELSE {wait(at, 1)} / ((n - j + 1) * top) END::DOUBLE AS gap FROM ordered)""",
        "arrivals": f"""SELECT user_id, m, item_id, c = -1048576 AS late, wait + CASE WHEN c = -1048576 OR
            ('0x' || substr({pair}, 1, 13))::BIGINT / 4503599627370496.0 < w / top THEN 0 ELSE {wait(pair, 14)} / w END AS arrival
            FROM waits JOIN weighed USING (c, spot)""",
        "drawn": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY late, arrival, item_id) AS rank
            FROM arrivals ANTI JOIN excluded USING (user_id, item_id) QUALIFY rank <= m""",
    }


def _reordered(tables: dict[str, str]) -> dict[str, str]:
    """The exclusions before the needs, which count them."""
    first = ("cat", "excluded", "need")
    return {n: tables[n] for n in (*first, *(n for n in tables if n not in first))}


_POSITIVES = "SELECT DISTINCT user_id, item_id FROM {0} WHERE item_id IN (SELECT item_id FROM items)"
_NEGATIVES = "SELECT user_id, least((SELECT count(*) FROM cat) - count(*), floor(count(*) * {0}))::BIGINT AS m FROM excluded GROUP BY 1"
_LATE_CLICKS = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY timestamp, {_KEY.format('row_id')})
    > floor(count(*) OVER () * 0.8::DOUBLE) AS late FROM clicks) WHERE late"""
_LATE_PAIRS = "SELECT DISTINCT user_id, item_id FROM late"
_CANDIDATES = "SELECT user_id, item_id, 1::BIGINT AS positive FROM positives UNION ALL SELECT user_id, item_id, 0 FROM drawn"
_CANDIDATE_NEED = """SELECT user_id, least(30, (SELECT count(*) FROM cat) - count(c.item_id))::BIGINT AS m
    FROM positives LEFT JOIN cat c USING (item_id) GROUP BY 1"""
_WEIGHTS = {"popularity": "count(*)::DOUBLE", "popularity_inverse": "1.0::DOUBLE / count(*)"}
_GAIN = "sum(1 / log2(rank + 1)) FILTER (rank <= {0})"
_IDEAL = "list_sum(list_transform(range(1, {0} + 1), lambda i: 1 / log2(i + 1)))"
_AP = "coalesce(sum(place / rank), 0) / any_value(n_rel)"
_SCALED = "SELECT item_id, round(({0}) + 0.0, 6) AS size, round(({1}) + 0.0, 6) AS price FROM items{2}"
_STATS = ", (SELECT avg(size) AS ms, stddev_pop(size) AS ss, min(size) AS ls, max(size) AS hs, avg(price) AS mp, " \
         "stddev_pop(price) AS sp, min(price) AS lp, max(price) AS hp FROM items)"


def _gini(table: str, column: str, name: str) -> str:
    return f"""SELECT round(CASE WHEN sum(x) = 0 THEN 0 ELSE 2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)
        END, 6) AS {name} FROM (SELECT {column}::DOUBLE AS x, row_number() OVER (ORDER BY {column}) AS i FROM {table})"""


def _novelty(*columns: str) -> str:
    value = {
        "avg_self_information": "coalesce(avg(info), 0)", "avg_iif": "coalesce(avg(iif), 0)",
        "catalog_coverage": "count(DISTINCT item_id) / max(n_items)", "avg_popularity_rank": "avg(pop_rank)",
        "popularity_rank_std": "stddev_pop(pop_rank)", "min_popularity_rank": "min(pop_rank)",
        "max_popularity_rank": "max(pop_rank)", "long_tail_percentage": "avg(tail)", "personalized_novelty": "avg(fresh)",
    }
    return _sql("SELECT user_id, " + ", ".join(f"round({value[c]}, 6) AS {c}" for c in columns)
                + " FROM novel GROUP BY user_id", "novel")


def _entity_split(column: str, least: int) -> str:
    return _sql(f"""SELECT row_id, split FROM purchases JOIN (SELECT {column}, CASE WHEN
        row_number() OVER (ORDER BY {_KEY.format(column)}, {column}) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train'
        ELSE 'val' END AS split FROM (SELECT {column} FROM purchases GROUP BY 1 HAVING count(*) >= {least})) USING ({column})""",
        "purchases")


def _labels_of(table: str, value: str, *names: str) -> str:
    return _sql(f"""SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
        FROM (SELECT DISTINCT {value} AS value FROM {table})""", *names)


# Scores of the neighbourhood models on the clicks: (user_id, item_id, score) where it isn't zero.
_ITEM_KNN = {
    **_cosines("click_model", "item_id", "user_id"),
    "knn": """SELECT h.user_id, sim.b AS item_id, sum(sim) / any_value(n) AS score FROM (SELECT *, count(*) OVER (PARTITION BY user_id)
        AS n FROM click_seen) h JOIN sim ON sim.a = h.item_id GROUP BY ALL""",
    "active": "SELECT DISTINCT user_id FROM click_seen",
}
_USER_KNN = {
    **_cosines("click_model", "user_id", "item_id"),
    "near": """SELECT a AS user_id, b AS neighbor, sim FROM sim WHERE a <> b AND sim > 1e-9
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) <= 20""",
    "knn": """SELECT n.user_id, m.k AS item_id, sum(n.sim * m.c) / any_value(w) AS score FROM (SELECT *, sum(sim) OVER (PARTITION BY
        user_id) AS w FROM near) n JOIN m ON m.a = n.neighbor GROUP BY ALL""",
    "active": "SELECT DISTINCT user_id FROM near",
}


def _knn_lists(model: dict[str, str], k: int) -> str:
    """Whole-catalog lists of unseen items; users without any click get popular items."""
    return _sql(f"""SELECT user_id, item_id, round(score, 6) AS score, rank FROM (SELECT user_id, item_id, score,
        row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM pool QUALIFY rank <= {k} UNION ALL
        SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY pop DESC, item_id) AS rank
        FROM click_users CROSS JOIN click_pop WHERE user_id NOT IN (SELECT user_id FROM clicks) QUALIFY rank <= {k})""",
        "click_users", "click_seen", "click_model", "click_pop", **model,
        pool="""SELECT user_id, item_id, round(coalesce(knn.score, 0), 9) AS score FROM (SELECT user_id, item_id FROM click_users
            SEMI JOIN active USING (user_id) CROSS JOIN items) ANTI JOIN click_seen USING (user_id, item_id)
            LEFT JOIN knn USING (user_id, item_id)""")


def _walk_clicks(excluded: str) -> dict[str, str]:
    return _reordered(_walk("SELECT DISTINCT user_id, 10 AS m FROM click_test", excluded))


_SEEN_CLICKS = "SELECT user_id, item_id FROM click_seen"
_UNITS = "SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vectors"
_ILS = """SELECT user_id, count(*) AS n_vectors, coalesce(any_value(s), 0) AS ils FROM lists JOIN units USING (item_id) LEFT JOIN
    (SELECT a.user_id, avg(list_dot_product(p.v, q.v) / (p.n * q.n)) AS s FROM lists a JOIN lists b ON a.user_id = b.user_id
    AND a.rank < b.rank JOIN units p ON p.item_id = a.item_id JOIN units q ON q.item_id = b.item_id GROUP BY 1) USING (user_id)
    GROUP BY user_id"""
_APART = """SELECT 1 - sum(x) / (u * (u - 1)) AS personalization FROM (SELECT sum(1 / sqrt(a.n * b.n)) AS x
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM lists) a JOIN
    (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM lists) b ON a.item_id = b.item_id AND a.user_id <> b.user_id),
    (SELECT count(DISTINCT user_id)::DOUBLE AS u FROM click_test) GROUP BY u"""
_NOVELTY_COLUMNS = {
    "avg_self_information": "coalesce(avg(-log2(greatest(k.pop / total, 1e-10))), 0)",
    "avg_iif": "coalesce(avg(ln(people / (k.pop + 1e-10))), 0)", "catalog_coverage": "count(DISTINCT r.item_id) / any_value(kinds)",
    "avg_popularity_rank": "avg(coalesce(k.pop_rank, kinds))", "popularity_rank_std": "stddev_pop(coalesce(k.pop_rank, kinds))",
    "min_popularity_rank": "min(coalesce(k.pop_rank, kinds))::DOUBLE", "max_popularity_rank": "max(coalesce(k.pop_rank, kinds))::DOUBLE",
    "long_tail_percentage": "avg(coalesce(k.pop_rank >= floor(kinds * 0.2), false)::INT)",
    "personalized_novelty": "avg((h.user_id IS NULL)::INT)",
}


def _list_novelty(source: str) -> dict[str, str]:
    """Novelty of ``lists`` against the interactions ``source``."""
    return {
        "known": f"""SELECT item_id, count(*) AS pop, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 AS pop_rank
            FROM {source} GROUP BY 1""",
        "new": "SELECT r.user_id, " + ", ".join(f"{v} AS {n}" for n, v in _NOVELTY_COLUMNS.items()) + f""" FROM lists r
            LEFT JOIN known k USING (item_id) LEFT JOIN (SELECT DISTINCT user_id, item_id FROM {source}) h
            ON h.user_id = r.user_id AND h.item_id = r.item_id, (SELECT sum(pop) AS total, count(*) AS kinds FROM known),
            (SELECT count(DISTINCT user_id) AS people FROM {source}) GROUP BY r.user_id""",
    }


def _retrieval(method: str, lists: str, *names: str, **own: str) -> str:
    """Accuracy, novelty and diversity of ``lists`` (user_id, item_id, rank) for the users of the later clicks."""
    return _sql("""SELECT summary.*, round((SELECT avg(avg_self_information) FROM new), 6) AS avg_self_information,
        round((SELECT avg(avg_iif) FROM new), 6) AS avg_iif, round((SELECT avg(catalog_coverage) FROM new), 6) AS avg_catalog_coverage,
        round((SELECT avg(coalesce(ils, 0)) FROM new LEFT JOIN ils USING (user_id)), 6) AS avg_intra_list_similarity,
        round((SELECT avg(personalized_novelty) FROM new), 6) AS avg_personalized_novelty,
        round((SELECT personalization FROM apart), 6) AS avg_personalization, '""" + method + "' AS evaluation_method FROM summary",
        "clicks", "items", "vectors", "click_test", "click_seen", "click_model", "click_pop", *names, **own, lists=lists,
        units=_UNITS, ils=_ILS, apart=_APART, **_list_novelty("clicks"),
        rel="SELECT user_id, item_id, count(*) AS n FROM click_test GROUP BY ALL",
        per=f"""SELECT t.user_id, coalesce(h.hits / l.n, 0) AS p, coalesce(h.hits / t.rows, 0) AS r, (coalesce(h.hits, 0) > 0)::INT AS h,
            coalesce(h.gain / {_IDEAL.format('least(t.kinds, 10)')}, 0) AS g, coalesce(1 / h.first, 0) AS f
            FROM (SELECT user_id, count(*) AS kinds, sum(n) AS rows FROM rel GROUP BY 1) t
            LEFT JOIN (SELECT user_id, count(*) AS n FROM lists GROUP BY 1) l USING (user_id)
            LEFT JOIN (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain, min(rank) AS first
            FROM lists SEMI JOIN rel USING (user_id, item_id) GROUP BY 1) h USING (user_id)""",
        summary=_RETRIEVAL)


def _ranked_pool(score: str, source: str = "pool") -> str:
    return f"""SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {score}, item_id) AS rank
        FROM {source} QUALIFY rank <= 10"""


def _sampled_pool(**own: str) -> dict[str, str]:
    """Later positives and 30 uniform negatives a user."""
    return {"late": _LATE_CLICKS, "positives": _LATE_PAIRS, **_reordered(_walk(_CANDIDATE_NEED, "SELECT * FROM positives")), **own,
            "pool": "SELECT user_id, item_id FROM positives UNION ALL SELECT user_id, item_id FROM drawn"}


_KNN_POOL = """SELECT user_id, item_id, coalesce(round(knn.score, 9), 0) AS score FROM pool SEMI JOIN items USING (item_id)
    SEMI JOIN active USING (user_id) LEFT JOIN knn USING (user_id, item_id)"""

_WORDS = r"list_filter(regexp_split_to_array(trim({0}, ' '), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def _swapped(rows: str, key: str, text: str, prob: float) -> str:
    """One pass of neighbour swaps: a place holds the next word where it is swapped, else the word held since the last place that isn't."""
    draw = _U01.format(f"({key} || '|' || i)")
    return f"""WITH t AS ({rows}), w AS (SELECT {key}, {_WORDS.format(text)} AS w FROM t),
        p AS (SELECT {key}, w, unnest(range(0, len(w))) AS i FROM w), s AS (SELECT *, i < len(w) - 1 AND {draw} < {prob} AS swap FROM p),
        h AS (SELECT *, coalesce(max(CASE WHEN NOT swap THEN i + 1 END) OVER (PARTITION BY {key} ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s)
        SELECT {key}, coalesce(string_agg(CASE WHEN swap THEN w[i + 2] ELSE w[held + 1] END, ' ' ORDER BY i), '') AS augmented
        FROM t LEFT JOIN h USING ({key}) GROUP BY {key}"""


# Mini-batches of 64 vectors in hash order of their ids, each with a mixed copy: symmetric cross-entropy at temperature 0.1.
_BATCHES = {
    "pairs": "SELECT item_id, v AS a, list_transform(v, lambda x, i: x + v[i % len(v) + 1] * 0.5::DOUBLE) AS b FROM vectors",
    "batched": f"""SELECT *, (row_number() OVER (ORDER BY {_KEY.format('item_id')}, item_id) - 1) // 64 AS batch_id,
        greatest(sqrt(list_dot_product(a, a)), 1e-12) AS na, greatest(sqrt(list_dot_product(b, b)), 1e-12) AS nb FROM pairs""",
    "logits": """SELECT x.batch_id, x.item_id AS i, y.item_id AS j, list_dot_product(x.a, y.b) / (x.na * y.nb) / 0.1::DOUBLE AS l
        FROM batched x JOIN batched y USING (batch_id)""",
    "sides": """SELECT batch_id, i, ln(sum(exp(l - 10))) + 10 - max(l) FILTER (i = j) AS loss FROM logits GROUP BY ALL UNION ALL
        SELECT batch_id, j, ln(sum(exp(l - 10))) + 10 - max(l) FILTER (i = j) FROM logits GROUP BY ALL""",
    "batches": "SELECT batch_id, count(*) // 2 AS rows, avg(loss) AS loss FROM sides GROUP BY 1",
}
_BCE = """SELECT avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS bce
    FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM labelled)"""

_PER_USER = f"row_number() OVER (PARTITION BY user_id ORDER BY {_KEY.format('row_id')}, row_id)"
_TRAIN_ROWS = "least(greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.8::DOUBLE)), count(*) OVER (PARTITION BY user_id) - 1)"
_RETRIEVAL = """SELECT round(avg(p), 6) AS avg_precision_at_k, round(avg(r), 6) AS avg_recall_at_k,
    round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS avg_f1_at_k, round(avg(h), 6) AS avg_hit_rate_at_k,
    round(avg(g), 6) AS avg_ndcg_at_k, round(avg(f), 6) AS avg_mrr, count(*) AS num_users_evaluated FROM per"""
_CLEAN_TEXT = r"trim(regexp_replace(lower(regexp_replace({0}, '<.*?>', '', 'g')), '[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "load_interactions": "SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, o_orderdate AS timestamp "
                         "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "load_items": "SELECT p_partkey::VARCHAR AS item_id, p_name AS title, CASE WHEN p_size > 5 THEN p_size ELSE 0 END::DOUBLE AS size, "
                  "round(p_retailprice, 6) AS price FROM part",
    "feature_table_incremental": "SELECT p_partkey::VARCHAR AS item_id, round(ln(1 + p_size), 6) AS log_size, "
                                 "round(ln(1 + p_retailprice), 6) AS log_price FROM part",
    "target_users_sample": _sql(f"SELECT user_id FROM (SELECT DISTINCT user_id FROM purchases) ORDER BY {_KEY.format('user_id')}, "
                                "user_id LIMIT 20", "purchases"),
    "image_lookup": _sql("SELECT item_id, path, ext FROM found", "found"),
    "valid_images": _sql("SELECT item_id FROM valid", "valid"),
    "image_manifest": _sql("""SELECT item_id, path, length, heavy AS compress,
        CASE WHEN heavy AND edge > 1024 THEN floor(width * (1024.0::DOUBLE / edge)) ELSE width END::BIGINT AS target_width,
        CASE WHEN heavy AND edge > 1024 THEN floor(height * (1024.0::DOUBLE / edge)) ELSE height END::BIGINT AS target_height
        FROM (SELECT *, length / 1024.0 > 500 AS heavy, greatest(width, height) AS edge FROM found)""", "found"),
    "items_with_images": _sql("SELECT item_id, title, tag, category, size, round(price, 6) AS price FROM items SEMI JOIN valid USING (item_id)",
                              "items", "valid"),
    "preprocess_summary": _sql("""SELECT count(*) AS interactions, count(DISTINCT user_id) AS users,
        (SELECT count(*) FROM items SEMI JOIN valid USING (item_id) SEMI JOIN b USING (item_id)) AS items,
        count(DISTINCT item_id) AS interacted_items FROM b""", "purchases", "items", "valid",
        r="SELECT * FROM purchases SEMI JOIN valid USING (item_id)",
        a="SELECT * FROM r WHERE item_id IN (SELECT item_id FROM r GROUP BY 1 HAVING count(*) >= 25)",
        b="SELECT * FROM a WHERE user_id IN (SELECT user_id FROM a GROUP BY 1 HAVING count(*) >= 20)"),
    "valid_item_filter": _sql("SELECT row_id, user_id, item_id FROM purchases WHERE item_id IN (SELECT item_id FROM items "
                              "WHERE size >= 10)", "purchases", "items"),
    "activity_filter": _sql("SELECT row_id, user_id, item_id FROM active", "active"),
    "align_items": _sql("SELECT item_id, title, tag FROM items WHERE item_id IN (SELECT item_id FROM clicks)", "items", "clicks"),
    "filtering_stats": _sql("""SELECT entity, o AS original, f AS filtered, round(f / o, 6) AS retention FROM (
        SELECT 'interactions' AS entity, (SELECT count(*) FROM purchases) AS o, (SELECT count(*) FROM active) AS f UNION ALL
        SELECT 'users', (SELECT count(DISTINCT user_id) FROM purchases), (SELECT count(DISTINCT user_id) FROM active) UNION ALL
        SELECT 'items', (SELECT count(*) FROM items), (SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM active)))""",
        "active", "items"),
    "clean_text": "SELECT page_id, " + _CLEAN_TEXT.format("html") + " AS cleaned FROM pages",
    "clean_text_columns": _sql("SELECT item_id, " + ", ".join(f"{_CLEAN_TEXT.format(c)} AS {c}" for c in ("title", "tag", "category"))
                               + " FROM items", "items"),
    "combined_text": _sql("""SELECT item_id, array_to_string(list_filter([trim(title), CASE WHEN size % 2 = 0 THEN trim(tag) END,
        CASE WHEN size % 5 = 0 THEN '' ELSE trim(category) END], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS combined FROM items""",
        "items"),
    "rare_tag_grouping": _sql("SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY tag || '-' || category) < 14 THEN 'rare_tag' "
                              "ELSE tag || '-' || category END AS tag FROM items", "items"),
    "strip_html": "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS stripped FROM pages",
    "encode_users": _labels_of("purchases", "user_id", "purchases"),
    "encode_items": _labels_of("items", "item_id", "items"),
    "encode_tag": _labels_of("items", "CASE WHEN size <> 13 THEN tag ELSE 'unknown' END", "items"),
    "indexed_interactions": _sql("SELECT row_id, user_idx, item_idx FROM purchases JOIN u USING (user_id) JOIN i USING (item_id)",
        "purchases", "items", u="SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT "
        "user_id FROM purchases)", i="SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM items"),
    "decoded_interactions": _sql("SELECT row_id, item_id FROM clicks SEMI JOIN items USING (item_id)", "clicks", "items"),
    "fit_scaler": _sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
        f"round(max({c})::DOUBLE, 6) AS max FROM items" for c in ("size", "price")), "items"),
    "scale_standard": _sql(_SCALED.format("(size - ms) / ss", "(price - mp) / sp", _STATS), "items"),
    "scale_minmax": _sql(_SCALED.format("(size - ls) / (hs - ls)", "(price - lp) / (hp - lp)", _STATS), "items"),
    "scale_log1p": _sql(_SCALED.format("ln(1 + size)", "ln(1 + price)", ""), "items"),
    "numeric_feature_vector": _sql("""SELECT item_id, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 6) AS x0,
        round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS x1
        FROM (SELECT *, CASE WHEN size % 9 = 0 THEN 0 ELSE size END AS s FROM items)""", "items"),
    "item_features": _sql("""SELECT item_id, round((size - ls) / (hs - ls), 6) AS x0, round((price - lp) / (hp - lp), 6) AS x1, tag_idx,
        trim(title) || ' ' || t AS text
        FROM (SELECT *, CASE WHEN size <> 13 THEN tag ELSE 'unknown' END AS t FROM items) LEFT JOIN tags USING (t),
        (SELECT min(size) AS ls, max(size) AS hs, min(price) AS lp, max(price) AS hp FROM items)""", "items",
        tags="SELECT t, row_number() OVER (ORDER BY t) - 1 AS tag_idx FROM (SELECT DISTINCT CASE WHEN size <> 13 THEN tag "
             "ELSE 'unknown' END AS t FROM items)"),
    "fused_features": _sql("""SELECT item_id, len(f)::BIGINT AS width, round(list_sum(f), 6) AS total, round(f[1], 6) AS first FROM (
        SELECT item_id, [ln(1 + size), ln(1 + price)] || coalesce(v, []) AS f
        FROM items LEFT JOIN vectors USING (item_id)) WHERE len(f) > 0""", "items", "vectors"),
    "embedding_cosine": _sql("""SELECT item_id, round(list_cosine_similarity(v, anchor), 6) AS cosine FROM vectors
        JOIN (SELECT label, arg_min(v, item_id::BIGINT) AS anchor FROM vectors GROUP BY 1) USING (label)""", "vectors"),
    "topk_per_user": _sql("""SELECT user_id, item_id, round(sum(value), 6) AS score, row_number() OVER (PARTITION BY user_id
        ORDER BY round(sum(value), 6) DESC, item_id) AS rank FROM clicks GROUP BY user_id, item_id QUALIFY rank <= 10""", "clicks"),
    "popularity_ranks": _sql("SELECT item_id, count(*) AS pop, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 AS pop_rank "
                             "FROM purchases GROUP BY 1", "purchases"),
    "item_popularity": _sql("SELECT item_id, count(*) AS pop FROM purchases GROUP BY 1", "purchases"),
    "user_activity": _sql("SELECT user_id, count(*) AS rows FROM purchases GROUP BY 1", "purchases"),
    "user_history": _sql("SELECT DISTINCT user_id, item_id FROM purchases", "purchases"),
    "distribution_shift": _sql("""SELECT value, round(coalesce(a, 0), 6) AS share_a, round(coalesce(b, 0), 6) AS share_b,
        round(abs(coalesce(a, 0) - coalesce(b, 0)), 6) AS gap FROM (SELECT value, count(*) / sum(count(*)) OVER () AS a FROM r
        WHERE early GROUP BY 1) FULL JOIN (SELECT value, count(*) / sum(count(*)) OVER () AS b FROM r WHERE NOT early GROUP BY 1)
        USING (value)""", "purchases",
        r=f"SELECT strftime(timestamp, '%Y-%m') AS value, row_number() OVER (ORDER BY {_KEY.format('row_id')}) "
          "<= round(count(*) OVER () * 0.3::DOUBLE) AS early FROM purchases"),
    "attach_stratum": _sql("SELECT row_id, tag FROM purchases LEFT JOIN items USING (item_id)", "purchases", "items"),
    "split_stratified_column": _sql("SELECT row_id, split FROM labelled_rows", "purchases", "items", **_column_split("purchases")),
    "split_job_counts": _sql("SELECT split, count(*) AS rows FROM labelled_rows GROUP BY 1", "purchases", "items",
        a1="SELECT * FROM purchases WHERE item_id IN (SELECT item_id FROM purchases GROUP BY 1 HAVING count(*) >= 25)",
        a2="SELECT * FROM a1 WHERE user_id IN (SELECT user_id FROM a1 GROUP BY 1 HAVING count(*) >= 20)", **_column_split("a2")),
    "split_stratified_temporal": _sql("SELECT row_id, split FROM done", "purchases", "items", **_temporal_strata()),
    "leakage_check": _sql("""SELECT *, train_end <= later_start AS ordered FROM (SELECT
        max(timestamp) FILTER (split = 'train') AS train_end, min(timestamp) FILTER (split <> 'train') AS later_start,
        count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (split = 'train') AS users_without_train FROM done)""",
        "purchases", "items", **_temporal_strata()),
    "split_statistics": _sql("SELECT " + ", ".join(
        [f"(SELECT count(*) FROM done WHERE split = '{p}') AS {p}_rows" for p in ("train", "val", "test")]
        + [f"(SELECT count(DISTINCT {e}_id) FROM done WHERE split = '{p}') AS {p}_{e}s" for e in ("user", "item") for p in ("train", "val", "test")]
        + [f"(SELECT count(DISTINCT {e}_id) FROM done WHERE split = '{p}' AND {e}_id IN (SELECT {e}_id FROM done WHERE split = 'train')) "
           f"AS {e}_overlap_{p}" for e in ("user", "item") for p in ("val", "test")]
        + [f"(SELECT round(count(DISTINCT {e}_id) FILTER ({e}_id IN (SELECT {e}_id FROM done WHERE split = 'train')) / count(DISTINCT {e}_id), 6) "
           f"FROM done WHERE split = '{p}') AS {e}_overlap_ratio_{p}" for e in ("user", "item") for p in ("val", "test")]),
        "purchases", "items", **_temporal_strata()),
    "split_user": _entity_split("user_id", 30),
    "split_item": _entity_split("item_id", 25),
    "split_per_user": _sql(f"SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 20 OR {_PER_USER} <= {_TRAIN_ROWS} "
                           "THEN 'train' ELSE 'val' END AS split FROM purchases", "purchases"),
    "split_random": _sql(f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {_KEY.format('row_id')}) <= "
                         "round(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM purchases", "purchases"),
    "split_temporal": _sql("SELECT row_id, CASE WHEN early THEN 'train' ELSE 'val' END AS split FROM halves", "halves"),
    "split_leave_one_out": _sql("""SELECT row_id, CASE WHEN n < 3 OR r > 2 THEN 'train' WHEN r = 1 THEN 'test' ELSE 'val' END AS split
        FROM (SELECT row_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id
        ORDER BY timestamp DESC, item_id DESC, row_id DESC) AS r FROM purchases)""", "purchases"),
    "split_cold_start": _sql(f"""SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 OR {_PER_USER} <= {_TRAIN_ROWS}
        THEN 'train' ELSE 'val_warm' END AS split FROM marked WHERE NOT cu AND NOT ci UNION ALL SELECT row_id,
        CASE WHEN cu AND ci THEN 'val_cold_both' WHEN cu THEN 'val_cold_user' ELSE 'val_cold_item' END FROM marked WHERE cu OR ci""",
        "purchases",
        nu="SELECT user_id, count(*) AS c FROM purchases GROUP BY 1", ni="SELECT item_id, count(*) AS c FROM purchases GROUP BY 1",
        marked="""SELECT p.*, nu.c <= (SELECT quantile_cont(c, 0.1) FROM nu) AS cu, ni.c <= (SELECT quantile_cont(c, 0.1) FROM ni) AS ci
            FROM purchases p JOIN nu USING (user_id) JOIN ni USING (item_id)"""),
    "training_subsets": _sql("SELECT row_id, time_bin, level FROM levels", "purchases", **_subsets("purchases")),
    "subset_shift": _sql("""SELECT g.level, round(max(abs(a - coalesce(b, 0))), 6) AS largest_gap,
        round(sum(abs(a - coalesce(b, 0))) / 2, 6) AS variation FROM (SELECT l.level, m.month, m.a FROM (VALUES (1), (2), (3)) l(level),
        (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) / sum(count(*)) OVER () AS a FROM levels GROUP BY 1) m) g
        LEFT JOIN (SELECT level, month, n / sum(n) OVER (PARTITION BY level) AS b FROM (SELECT v.level AS level,
        strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM levels, (VALUES (1), (2), (3)) v(level)
        WHERE levels.level >= v.level GROUP BY 1, 2)) k
        ON k.level = g.level AND k.month = g.month GROUP BY g.level""", "clicks", **_subsets("clicks")),
    "negatives_random": _sql("SELECT user_id, item_id, rank FROM drawn", "purchases", "items",
                             **_reordered(_walk(_NEGATIVES.format("1.0"), _POSITIVES.format("purchases")))),
    "negatives_rejection": _sql("SELECT user_id, item_id, rank FROM drawn", "clicks", "items",
                                **_reordered(_walk(_NEGATIVES.format("2.5"), _POSITIVES.format("clicks")))),
    "train_samples": _sql(f"""SELECT user_id, item_id, label, {_KEY.format("(user_id || '|' || item_id || '|' || label)")} AS order_key
        FROM (SELECT user_id, item_id, 1::BIGINT AS label FROM purchases WHERE item_id IN (SELECT item_id FROM items) UNION ALL
        SELECT user_id, item_id, 0 FROM drawn)""", "purchases", "items",
        **_reordered(_walk(_NEGATIVES.format("0.5"), _POSITIVES.format("purchases")))),
    **{f"negatives_{name}": _sql("SELECT user_id, item_id, rank FROM drawn", "purchases", "items", **_arrive(
        _NEGATIVES.format("1.0"), _POSITIVES.format("purchases"), f"SELECT item_id, {w} AS w FROM purchases GROUP BY 1"))
       for name, w in _WEIGHTS.items()},
    "eval_candidates": _sql(_CANDIDATES, "clicks", "items", late=_LATE_CLICKS, positives=_LATE_PAIRS,
                            **_reordered(_walk(_CANDIDATE_NEED, "SELECT * FROM positives"))),
    **{f"eval_candidates_{name}": _sql(_CANDIDATES, "clicks", "items", late=_LATE_CLICKS, positives=_LATE_PAIRS, **_arrive(
        _CANDIDATE_NEED, "SELECT * FROM positives", f"SELECT item_id, coalesce(any_value(k.w), 1.0) AS w FROM items LEFT JOIN "
        f"(SELECT item_id, {w} AS w FROM late GROUP BY 1) k USING (item_id) GROUP BY item_id")) for name, w in _WEIGHTS.items()},
    "rec_random": _sql(f"SELECT user_id, item_id, round({_PAIR}, 6) AS score, rank FROM drawn", "test", "history", "items",
        **_reordered(_walk("SELECT DISTINCT user_id, 10 AS m FROM test", "SELECT DISTINCT user_id, item_id FROM history"))),
    "item_similarity": _sql("SELECT a, b, round(sim, 6) AS sim FROM sim", "purchases", **_cosines("purchases", "item_id", "user_id")),
    "item_similarity_clicks": _sql("SELECT a, b, round(sim, 6) AS sim FROM sim", "clicks", **_cosines("clicks", "item_id", "user_id")),
    "user_similarity": _sql("SELECT a, b, round(sim, 6) AS sim FROM sim", "clicks", **_cosines("clicks", "user_id", "item_id")),
    "user_neighbors": _sql("""SELECT a AS user_id, b AS neighbor, round(sim, 6) AS sim, row_number() OVER (PARTITION BY a
        ORDER BY round(sim, 9) DESC, b) AS rank FROM sim WHERE a <> b AND sim > 1e-9 QUALIFY rank <= 20""",
        "clicks", **_cosines("clicks", "user_id", "item_id")),
    "rec_popularity": _sql("SELECT user_id, item_id, round(score, 6) AS score, rank FROM recs", "recs"),
    "recs_nested": _sql("SELECT user_id, string_agg(item_id || ':' || printf('%.6f', score), ',' ORDER BY rank) AS recommendations "
                        "FROM recs GROUP BY 1", "recs"),
    "score_random": _sql(f"SELECT user_id, item_id, CASE WHEN item_id IN (SELECT item_id FROM items) THEN "
                         f"round({_PAIR}, 6) ELSE 0 END AS score FROM pairs",
                         "test", "items", pairs="SELECT DISTINCT user_id, item_id FROM test UNION ALL SELECT min(user_id), 'no-item' "
                         "FROM test UNION ALL SELECT 'no-user', min(item_id) FROM test"),
    "score_popularity": _sql("SELECT user_id, item_id, round(coalesce(score, 0), 6) AS score FROM pairs LEFT JOIN scored USING (item_id)",
                             "test", "scored", pairs="SELECT DISTINCT user_id, item_id FROM test UNION ALL SELECT min(user_id), "
                             "'no-item' FROM test UNION ALL SELECT 'no-user', min(item_id) FROM test"),
    "rec_item_knn": _knn_lists(_ITEM_KNN, 10),
    "rec_item_knn_catalog": _knn_lists(_ITEM_KNN, 120),
    "rec_user_knn": _knn_lists(_USER_KNN, 10),
    **{f"score_{name}": _sql("SELECT user_id, item_id, round(coalesce(knn.score, 0), 6) AS score FROM click_pairs LEFT JOIN knn "
                             "USING (user_id, item_id)", "click_pairs", "click_seen", "click_model", **model)
       for name, model in (("item_knn", _ITEM_KNN), ("user_knn", _USER_KNN))},
    "rec_embedding_dot": _sql("""SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id
        ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, coalesce(round(list_dot_product(t, v), 9), 0) AS score
        FROM taste CROSS JOIN items LEFT JOIN vectors USING (item_id)) ANTI JOIN click_seen USING (user_id, item_id)
        QUALIFY rank <= 10""", "taste", "items", "vectors", "click_seen"),
    "rec_model": _sql("""SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id
        ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, coalesce(round(tanh(list_dot_product(v,
        list_transform(range(64), lambda i: -1 + i * (2 / 63)))), 9), 0) AS score FROM (SELECT user_id, item_id FROM positives UNION ALL
        SELECT user_id, item_id FROM drawn) SEMI JOIN items USING (item_id) ANTI JOIN click_seen USING (user_id, item_id)
        LEFT JOIN vectors USING (item_id)) QUALIFY rank <= 10""", "clicks", "items", "vectors", "click_seen", late=_LATE_CLICKS,
        positives=_LATE_PAIRS, **_reordered(_walk(_CANDIDATE_NEED.replace("least(30", "least(50"), "SELECT * FROM positives"))),
    "score_pairs": _sql("SELECT user_id, item_id, round(coalesce(CASE WHEN item_id IN (SELECT item_id FROM items) THEN "
                        "list_dot_product(t, v) END, 0), 6) AS score FROM click_pairs LEFT JOIN taste USING (user_id) LEFT JOIN vectors "
                        "USING (item_id)", "click_pairs", "taste", "items", "vectors"),
    "recs_for_users": _sql(f"""SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id
        ORDER BY pop DESC, item_id) AS rank FROM (SELECT user_id FROM (SELECT DISTINCT user_id FROM purchases)
        ORDER BY {_KEY.format('user_id')}, user_id LIMIT 20) CROSS JOIN scored ANTI JOIN (SELECT DISTINCT user_id, item_id FROM history)
        USING (user_id, item_id) QUALIFY rank <= 20""", "purchases", "scored", "history"),
    "eval_retrieval_random": _retrieval("negative_sampling", f"""SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
        ORDER BY {_KEY.format("(user_id || '|' || item_id)")}) AS rank FROM pool QUALIFY rank <= 10""", **_sampled_pool()),
    "eval_retrieval_popularity": _retrieval("negative_sampling", _ranked_pool("score DESC", "pool JOIN click_pop USING (item_id)"),
                                            **_sampled_pool()),
    "eval_retrieval_item_knn": _retrieval("negative_sampling", _ranked_pool("score DESC", f"({_KNN_POOL})"), **_sampled_pool(**_ITEM_KNN)),
    "eval_retrieval_user_knn": _retrieval("negative_sampling", _ranked_pool("score DESC", f"({_KNN_POOL})"), **_sampled_pool(**_USER_KNN)),
    "eval_retrieval_catalog": _retrieval("catalog_evaluation", _ranked_pool(
        "pop DESC", "(SELECT DISTINCT user_id FROM click_test) CROSS JOIN click_pop")),
    "eval_retrieval_positives": _retrieval("full_evaluation", _ranked_pool(
        "score DESC", "(SELECT DISTINCT user_id, item_id FROM click_test) JOIN click_pop USING (item_id)")),
    "novelty_per_user": _sql("SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NOVELTY_COLUMNS) + """, round(ils, 6) AS ils
        FROM new LEFT JOIN ils USING (user_id)""", "click_test", "click_seen", "items", "vectors", **_walk_clicks(_SEEN_CLICKS),
        lists="SELECT * FROM drawn", units=_UNITS, ils=_ILS, **_list_novelty("click_history")),
    "intra_list_similarity": _sql("SELECT user_id, n_vectors, round(ils, 6) AS ils FROM ils", "click_test", "click_seen", "items",
        "vectors", **_walk_clicks(_SEEN_CLICKS), lists="SELECT * FROM drawn", units=_UNITS, ils=_ILS),
    "pairwise_diversity_cosine": _sql("SELECT user_id, round(CASE WHEN n_vectors > 1 THEN 1 - ils ELSE 0 END, 6) AS diversity FROM ils",
        "click_test", "click_seen", "items", "vectors", **_walk_clicks(_SEEN_CLICKS), lists="SELECT * FROM drawn", units=_UNITS, ils=_ILS),
    "pairwise_diversity_euclidean": _sql("""SELECT a.user_id, round(coalesce(avg(list_distance(p.v, q.v)), 0), 6) AS diversity
        FROM (lists a JOIN vectors p USING (item_id)) LEFT JOIN (lists b JOIN vectors q USING (item_id)) ON a.user_id = b.user_id AND
        a.rank < b.rank GROUP BY 1""", "click_test", "click_seen", "items", "vectors", **_walk_clicks(_SEEN_CLICKS),
        lists="SELECT * FROM drawn"),
    "personalization": _sql("SELECT round(personalization, 6) AS personalization FROM apart", "click_test", "click_seen", "items",
        **_walk_clicks(_SEEN_CLICKS), lists="SELECT * FROM drawn", apart=_APART),
    "serendipity": _sql("""SELECT round(avg(s), 6) AS serendipity FROM (SELECT avg((t.user_id IS NOT NULL AND e.item_id IS NULL)::INT)
        AS s FROM drawn LEFT JOIN (SELECT DISTINCT user_id, item_id FROM click_test) t USING (user_id, item_id) LEFT JOIN
        (SELECT item_id FROM click_pop ORDER BY pop DESC, item_id LIMIT 20) e USING (item_id) GROUP BY drawn.user_id)""",
        "click_test", "click_pop", "items", **_walk_clicks("SELECT user_id, item_id FROM click_test WHERE false")),
    "satisfaction_proxy": _sql("""SELECT round(avg(c), 6) AS satisfaction FROM (SELECT avg(c) AS c FROM (SELECT r.user_id,
        sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-8) AS c FROM recs r JOIN facts f USING (item_id) JOIN likes l
        ON l.user_id = r.user_id AND l.feature = f.feature GROUP BY r.user_id, r.item_id) GROUP BY user_id)""", "recs", "history", "items",
        facts="SELECT item_id, tag AS feature, 1.0::DOUBLE AS q FROM items UNION ALL SELECT item_id, category, 0.5 FROM items UNION ALL "
              "SELECT item_id, 'price', price / 1000 FROM items",
        likes="SELECT user_id, feature, avg(q) * count(*) AS p FROM history JOIN facts USING (item_id) GROUP BY ALL"),
    "precision_at_k": _sql("SELECT user_id, round(count(*) FILTER (rank <= 5) / 5.0, 6) AS precision FROM hits GROUP BY 1", "hits"),
    "recall_at_k": _sql("SELECT user_id, round(count(rank) / any_value(n_rel), 6) AS recall FROM hits GROUP BY 1", "hits"),
    "ndcg_list": _sql(f"SELECT user_id, round(coalesce({_GAIN.format(10)} / {_IDEAL.format('count(rank)')}, 0), 6) AS ndcg "
                      "FROM hits GROUP BY 1", "hits"),
    "average_precision": _sql(f"SELECT user_id, round({_AP}, 6) AS ap FROM hits GROUP BY 1", "hits"),
    "map": _sql(f"SELECT round(avg(ap), 6) AS map FROM (SELECT {_AP} AS ap FROM hits GROUP BY user_id)", "hits"),
    "mrr": _sql("SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM hits WHERE place = 1", "hits"),
    "hit_rate": _sql("SELECT round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate FROM hits WHERE place = 1", "hits"),
    "self_information": _novelty("avg_self_information"),
    "iif": _novelty("avg_iif"),
    "catalog_coverage": _novelty("catalog_coverage"),
    "popularity_stats": _novelty("avg_popularity_rank", "popularity_rank_std", "min_popularity_rank", "max_popularity_rank"),
    "long_tail_share": _novelty("long_tail_percentage"),
    "personalized_novelty": _novelty("personalized_novelty"),
    "coverage_diversity": _sql("SELECT round(count(DISTINCT item_id) / count(*), 6) AS coverage_diversity FROM recs", "recs"),
    "temporal_diversity": _sql("""SELECT round(avg(s), 6) AS temporal_diversity FROM (SELECT CASE WHEN count(*) < 2 THEN 0 ELSE
        stddev_pop(coalesce(d, 0)) END AS s FROM recs LEFT JOIN (SELECT item_id, min(date_diff('day', DATE '1970-01-01',
        timestamp::DATE))::DOUBLE AS d FROM history GROUP BY 1) USING (item_id) GROUP BY user_id)""", "recs", "history"),
    "gini": _sql(_gini("(SELECT count(*) AS c FROM purchases GROUP BY item_id)", "c", "gini"), "purchases"),
    "demographic_parity": _sql("""SELECT coalesce("group", 'unknown') AS "group", round(count(DISTINCT item_id) / count(*), 6) AS rate
        FROM recs LEFT JOIN users USING (user_id) GROUP BY 1""", "recs", "users"),
    "provider_exposure": _sql("SELECT provider, round(c / sum(c) OVER (), 6) AS exposure FROM exposed", "exposed"),
    "provider_gini": _sql(_gini("exposed", "c", "provider_gini"), "exposed"),
    "binary_metrics": _sql("""SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
        round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT
        count(*) FILTER (score > 0.5 AND label = 1) AS tp, count(*) FILTER (score > 0.5 AND label <> 1) AS fp,
        count(*) FILTER (score <= 0.5 AND label = 1) AS fn, count(*) FILTER (score <= 0.5 AND label <> 1) AS tn FROM labelled)""",
        "labelled"),
    "roc_auc": _sql("""SELECT round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * n), 6) AS auc FROM (SELECT label,
        rank() OVER (ORDER BY round(score, 2)) + (count(*) OVER (PARTITION BY round(score, 2)) - 1) / 2 AS r FROM labelled),
        (SELECT count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label <> 1)::DOUBLE AS n FROM labelled) GROUP BY p, n""",
        "labelled"),
    "bce_loss": _sql(f"SELECT round(bce, 6) AS bce FROM ({_BCE})", "labelled"),
    "contrastive_alignment": _sql("SELECT batch_id, rows, round(loss, 6) AS loss FROM batches", "vectors", **_BATCHES),
    "total_loss": _sql(f"""SELECT round(bce, 6) AS bce, round(contrastive, 6) AS contrastive, round(bce + contrastive * 0.1, 6) AS total
        FROM ({_BCE}), (SELECT avg(loss) AS contrastive FROM batches)""", "labelled", "vectors", **_BATCHES),
    "augment_delete": f"""SELECT doc_id, coalesce(array_to_string(list_filter({_WORDS.format("text")}, lambda w, i:
        {_U01.format("(doc_id || '|' || (i - 1))")} > 0.2), ' '), '') AS augmented FROM documents""",
    "augment_swap": _sql(_swapped("SELECT item_id, concat_ws(' ', title, tag, category) AS text FROM items", "item_id", "text", 0.5)
                         .replace("WITH t", ", t", 1), "items"),
    "augment_swap_documents": _swapped("SELECT doc_id, text FROM documents", "doc_id", "text", 0.2),
    "text_tfidf": f"""WITH f AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS bucket FROM
        (SELECT doc_id, unnest({_WORDS.format(_CLEAN_TEXT.format("text"))}) AS word FROM documents)),
        c AS (SELECT doc_id, bucket, count(*) AS tf FROM f GROUP BY ALL), d AS (SELECT bucket, count(*) AS df FROM c GROUP BY 1),
        w AS (SELECT doc_id, tf, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS weight FROM c JOIN d USING (bucket))
        SELECT doc_id, count(*) FILTER (weight <> 0) AS terms, coalesce(sum(tf), 0)::BIGINT AS words,
        round(coalesce(sum(weight), 0), 6) AS weight FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id""",
    "unseen_candidates": _sql("SELECT user_id, item_id FROM drawn ANTI JOIN (SELECT DISTINCT user_id, item_id FROM history) "
        "USING (user_id, item_id)", "test", "history", "items",
        **_reordered(_walk("SELECT DISTINCT user_id, 50 AS m FROM test", "SELECT user_id, item_id FROM history WHERE false"))),
    "eval_ranking": _sql("SELECT " + ", ".join(f"round(avg({c}), 6) AS avg_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in (
        "avg_rank", "median_rank", "mrr", "hit_rate_at_k", "ndcg_at_k")) + ", count(*) AS num_users_evaluated FROM per", "clicks",
        h=f"""SELECT *, row_number() OVER (ORDER BY timestamp, {_KEY.format('row_id')}) > floor(count(*) OVER () * 0.8::DOUBLE)
            AS late FROM clicks""",
        per=f"""SELECT (n + 1) / 2 AS avg_rank, (n + 1) / 2 AS median_rank, 1.0 AS mrr, least(n, 5) / n AS hit_rate_at_k,
            {_IDEAL.format('least(n, 5)')} / {_IDEAL.format('least(d, 5)')} AS ndcg_at_k FROM (SELECT user_id, count(*) AS n,
            count(DISTINCT item_id) AS d FROM h WHERE late GROUP BY 1)"""),
    "leave_one_out_popularity": _sql(_RETRIEVAL, "purchases", "items",
        f1="SELECT * FROM purchases WHERE item_id IN (SELECT item_id FROM purchases GROUP BY 1 HAVING count(*) >= 3)",
        f2="SELECT * FROM f1 WHERE user_id IN (SELECT user_id FROM f1 GROUP BY 1 HAVING count(*) >= 5)",
        l="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC, row_id DESC) AS r FROM f2",
        s="SELECT item_id, coalesce(c, 0) AS pop FROM items LEFT JOIN (SELECT item_id, count(*) AS c FROM f2 GROUP BY 1) USING (item_id)",
        top="""SELECT u.user_id, s.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY pop DESC, s.item_id) AS rank
            FROM (SELECT DISTINCT user_id FROM l WHERE r = 1) u CROSS JOIN s ANTI JOIN (SELECT DISTINCT user_id, item_id FROM l
            WHERE r > 2) h ON h.user_id = u.user_id AND h.item_id = s.item_id QUALIFY rank <= 10""",
        per="""SELECT any_value((rank IS NOT NULL)::INT / 10) AS p, any_value((rank IS NOT NULL)::INT) AS r,
            any_value((rank IS NOT NULL)::INT) AS h, any_value(coalesce(1 / log2(rank + 1), 0)) AS g,
            any_value(coalesce(1 / rank, 0)) AS f FROM (SELECT user_id, item_id FROM l WHERE r = 1) t
            LEFT JOIN top USING (user_id, item_id) GROUP BY user_id"""),
}
