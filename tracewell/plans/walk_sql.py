"""SQL of personalised walks."""


def walk_sql(steps: int = 300) -> str:
    """Power iteration of every task's walk over nd (node), lk (src, dst) and sd (query, node, w) for qq (query); rows pr (query, node, rank)."""
    return f"""ix AS (SELECT node, row_number() OVER (ORDER BY node) AS j FROM nd), dk AS (SELECT src, count(*) AS k FROM lk GROUP BY 1),
  il AS (SELECT d.j, list({{'s': s.j, 'w': 1.0 / k}}) AS l FROM lk JOIN ix s ON s.node = lk.src JOIN ix d ON d.node = lk.dst JOIN dk ON dk.src = lk.src GROUP BY d.j),
  mx AS (SELECT list(coalesce(l, []) ORDER BY ix.j) AS ins, list(ix.j) FILTER (WHERE dk.k IS NULL) AS ends, count(*) AS n FROM ix LEFT JOIN il ON il.j = ix.j LEFT JOIN dk ON dk.src = ix.node),
  vv AS (SELECT qq.query, list(CAST(CASE WHEN t.total > 0 THEN coalesce(sd.w, 0) / t.total ELSE 1.0 / (SELECT n FROM mx) END AS DOUBLE) ORDER BY ix.j) AS v FROM qq CROSS JOIN ix LEFT JOIN sd ON sd.query = qq.query AND sd.node = ix.node LEFT JOIN (SELECT query, sum(w) AS total FROM sd GROUP BY 1) t ON t.query = qq.query GROUP BY qq.query),
  pw(i, query, v, r) AS (SELECT 0, query, v, v FROM vv UNION ALL SELECT i + 1, query, v, list_transform(mx.ins, lambda l, j: 0.15 * v[j] + 0.85 * (coalesce(list_sum(list_transform(l, lambda e: r[e.s] * e.w)), 0) + coalesce(list_sum(list_transform(mx.ends, lambda e: r[e])), 0) / mx.n)) FROM pw, mx WHERE i < {steps}),
  pr AS (SELECT query, node, r[j] AS rank FROM pw, ix WHERE i = {steps})"""
