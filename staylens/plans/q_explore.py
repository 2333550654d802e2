"""Registered queries: exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import explore as X
from staylens.plans import frames
from staylens.plans.registry import register

NUMERIC_CLEAN = ["host_listings_count", "calculated_host_listings_count", "accommodates", "bedrooms", "beds",
                 "minimum_nights", "number_of_reviews", "review_scores_rating", "host_response_rate",
                 "host_acceptance_rate", "host_is_superhost", "price", "bathrooms", "log_price"]


def _bin_sql(col, lo, w, bins):
    return f"CAST(least({bins - 1}, floor(({col} - {lo}) / {w})) AS BIGINT)"


@register("histogram", """
SELECT g.bin, s.lo + g.bin * s.w AS bin_lo, s.lo + (g.bin + 1) * s.w AS bin_hi, coalesce(c.count, 0) AS count
FROM (SELECT * FROM range(0, 100) t(bin)) g
CROSS JOIN (SELECT min(price) AS lo, CASE WHEN max(price) > min(price) THEN (max(price) - min(price)) / 100
                                     ELSE 1.0 END AS w FROM listings_clean) s
LEFT JOIN (SELECT CAST(least(99, floor((price - s2.lo) / s2.w)) AS BIGINT) AS bin, count(*) AS count
           FROM listings_clean,
                (SELECT min(price) AS lo, CASE WHEN max(price) > min(price) THEN (max(price) - min(price)) / 100
                                          ELSE 1.0 END AS w FROM listings_clean) s2
           GROUP BY 1) c ON c.bin = g.bin""", {"bin_lo": 6, "bin_hi": 6})
def histogram(spark, sf):
    return X.histogram(frames.clean(spark, sf), "price", 100)


@register("kde_grid", """
SELECT g.point, s.g0 + g.point * s.step AS x,
       sum(exp(-0.5 * ((s.g0 + g.point * s.step - c.log_price) / s.h) * ((s.g0 + g.point * s.step - c.log_price) / s.h)))
         / (s.n * s.h * sqrt(2 * pi())) AS density
FROM (SELECT * FROM range(0, 200) t(point)) g
CROSS JOIN (SELECT n, h, lo - 3.0 * h AS g0, (hi - lo + 2 * 3.0 * h) / 199 AS step FROM (
             SELECT count(log_price) AS n, min(log_price) AS lo, max(log_price) AS hi,
                    stddev_samp(log_price) * pow(count(log_price), -1.0 / 5.0) AS h FROM listings_clean)) s
CROSS JOIN listings_clean c
GROUP BY g.point, s.g0, s.step, s.n, s.h""", {"x": 8, "density": 10})
def kde_grid(spark, sf):
    return X.kde_grid(frames.clean(spark, sf), "log_price", 200)


@register("axis_quantile", "SELECT quantile_cont(price, 0.95) AS quantile FROM listings_clean", {"quantile": 6})
def axis_quantile(spark, sf):
    return X.axis_quantile(frames.clean(spark, sf), "price", 0.95)


BOX_SQL = """
SELECT q.room_type, q.q1, q.median, q.q3, q.n, w.whisker_low, w.whisker_high, w.outliers FROM (
  SELECT room_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
         quantile_cont(price, 0.75) AS q3, count(price) AS n
  FROM listings_clean GROUP BY room_type) q
JOIN (
  SELECT c.room_type,
         min(CASE WHEN c.price >= b.q1 - 1.5 * (b.q3 - b.q1) THEN c.price END) AS whisker_low,
         max(CASE WHEN c.price <= b.q3 + 1.5 * (b.q3 - b.q1) THEN c.price END) AS whisker_high,
         count(CASE WHEN c.price < b.q1 - 1.5 * (b.q3 - b.q1) OR c.price > b.q3 + 1.5 * (b.q3 - b.q1) THEN 1 END)
           AS outliers
  FROM listings_clean c JOIN (SELECT room_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
                              FROM listings_clean GROUP BY room_type) b USING (room_type)
  GROUP BY c.room_type) w USING (room_type)"""


@register("box_stats", BOX_SQL, {"q1": 6, "median": 6, "q3": 6})
def box_stats(spark, sf):
    return X.box_stats(frames.clean(spark, sf), "room_type", "price")


@register("value_counts", """
SELECT room_type, count(*) AS count FROM listings_clean WHERE room_type IS NOT NULL GROUP BY room_type""")
def value_counts(spark, sf):
    return X.value_counts(frames.clean(spark, sf), "room_type")


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM listings_clean"
    for a in NUMERIC_CLEAN for b in NUMERIC_CLEAN)


@register("corr_matrix", CORR_SQL, {"corr": 8})
def corr_matrix(spark, sf):
    return X.corr_matrix(frames.clean(spark, sf), NUMERIC_CLEAN)


@register("corr_with_target", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, corr(CAST({a} AS DOUBLE), log_price) AS corr FROM listings_clean"
    for a in NUMERIC_CLEAN if a != "log_price"), {"corr": 8})
def corr_with_target(spark, sf):
    return X.corr_with_target(frames.clean(spark, sf), NUMERIC_CLEAN, "log_price")


SCATTER_COLS = ["price", "accommodates", "bedrooms", "beds", "review_scores_rating"]


def _scatter_sql():
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, "
                      f"CASE WHEN max({c}) > min({c}) THEN (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 10 "
                      f"ELSE 1.0 END AS w_{c}" for c in SCATTER_COLS)
    parts = []
    for i, a in enumerate(SCATTER_COLS):
        for b in SCATTER_COLS[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS col_x, '{b}' AS col_y, "
                f"CAST(least(9, floor((CAST({a} AS DOUBLE) - s.lo_{a}) / s.w_{a})) AS BIGINT) AS bin_x, "
                f"CAST(least(9, floor((CAST({b} AS DOUBLE) - s.lo_{b}) / s.w_{b})) AS BIGINT) AS bin_y "
                f"FROM listings_clean, scatter_stats s WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return (f"SELECT col_x, col_y, bin_x, bin_y, count(*) AS count FROM ({' UNION ALL '.join(parts)}) "
            f"GROUP BY ALL", f"scatter_stats AS (SELECT {stats} FROM listings_clean)")


_SC_SQL, _SC_CTE = _scatter_sql()


@register("scatter_matrix", _SC_SQL, None, _SC_CTE)
def scatter_matrix(spark, sf):
    return X.scatter_matrix(frames.clean(spark, sf), SCATTER_COLS, 10)


@register("reg_line", """
SELECT regr_slope(price, bedrooms) AS slope, regr_intercept(price, bedrooms) AS intercept,
       CAST(regr_count(price, bedrooms) AS BIGINT) AS n FROM listings_clean""", {"slope": 6, "intercept": 4})
def reg_line(spark, sf):
    return X.reg_line(frames.clean(spark, sf), "bedrooms", "price")


BAND_CTES = f"""
band_b AS (SELECT CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 7)) AS BIGINT) % {X.BAND_BUCKETS} AS bucket,
                  count(*) AS n, sum(CAST(bedrooms AS DOUBLE)) AS x, sum(price) AS y,
                  sum(CAST(bedrooms AS DOUBLE) * bedrooms) AS xx, sum(bedrooms * price) AS xy
           FROM listings_keyed_clean WHERE bedrooms IS NOT NULL AND price IS NOT NULL GROUP BY 1),
band_w AS (SELECT *, len(list_filter([{', '.join(map(repr, X.poisson1_cdf()))}], lambda c: c <= u)) AS w FROM (
  SELECT *, CAST(CAST('0x' || substr(md5('42:' || CAST(bucket AS VARCHAR) || ':' || CAST(draw AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)
            / {float(1 << 52)!r} AS u
  FROM band_b, (SELECT unnest(generate_series(0, 999)) AS draw))),
band_s AS (SELECT draw, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * xy) AS xy FROM band_w GROUP BY draw),
band_f AS (SELECT b1, (y - b1 * x) / n AS b0 FROM (SELECT *, (n * xy - x * y) / (n * xx - x * x) AS b1 FROM band_s)),
band_g AS (SELECT CAST(k AS INT) AS point, lo + k * (hi - lo) / 99 AS x FROM (SELECT unnest(generate_series(0, 99)) AS k),
  (SELECT min(CAST(bedrooms AS DOUBLE)) AS lo, max(CAST(bedrooms AS DOUBLE)) AS hi FROM listings_keyed_clean
   WHERE bedrooms IS NOT NULL AND price IS NOT NULL))"""


@register("reg_line_band", """
SELECT point, x, quantile_cont(b0 + b1 * x, 0.025) AS band_lo, quantile_cont(b0 + b1 * x, 0.975) AS band_hi
FROM band_g, band_f GROUP BY point, x""", {"x": 8, "band_lo": 4, "band_hi": 4}, BAND_CTES)
def reg_line_band(spark, sf):
    return X.reg_band(frames.keyed(spark, sf), "bedrooms", "price", key="id", n_boot=1000, points=100)


TOP_SQL = """
SELECT neighbourhood, quantile_cont(price, 0.5) AS median FROM listings_clean
GROUP BY neighbourhood ORDER BY median DESC, neighbourhood ASC LIMIT 10"""


@register("top_neighbourhoods", TOP_SQL, {"median": 6})
def top_neighbourhoods(spark, sf):
    return X.top_by_median(frames.clean(spark, sf), "neighbourhood", "price", 10)


@register("semi_join_top", """
SELECT id, neighbourhood, price FROM listings_keyed_clean
WHERE neighbourhood IN (SELECT neighbourhood FROM (""" + TOP_SQL + "))")
def semi_join_top(spark, sf):
    k = frames.keyed(spark, sf)
    top = X.top_by_median(k, "neighbourhood", "price", 10)
    return X.semi_join_top(k, top, "neighbourhood").select("id", "neighbourhood", "price")


@register("geo_grid", """
SELECT CAST(floor(CAST(bedrooms AS DOUBLE) / 1.0) AS BIGINT) AS cell_x,
       CAST(floor(review_scores_rating / 1.0) AS BIGINT) AS cell_y,
       count(*) AS count, avg(price) AS mean, quantile_cont(price, 0.5) AS median
FROM listings_clean WHERE bedrooms IS NOT NULL AND review_scores_rating IS NOT NULL GROUP BY 1, 2""",
          {"mean": 6, "median": 6})
def geo_grid(spark, sf):
    return X.geo_grid(frames.clean(spark, sf), "bedrooms", "review_scores_rating", 1.0, "price") \
        .select("cell_x", "cell_y", "count", "mean", "median")


RESIDUAL_CTES = """
rp AS (SELECT prediction AS pred, label - prediction AS residual FROM ols_scored
       WHERE label - prediction IS NOT NULL),
rs AS (SELECT min(residual) AS lo_r,
              CASE WHEN max(residual) > min(residual) THEN (max(residual) - min(residual)) / 50 ELSE 1.0 END AS w_r,
              min(pred) AS lo_p,
              CASE WHEN max(pred) > min(pred) THEN (max(pred) - min(pred)) / 50 ELSE 1.0 END AS w_p
       FROM rp)
"""


@register("residual_profile", """
SELECT 'hist' AS kind, g.b AS bin_x, CAST(NULL AS BIGINT) AS bin_y, coalesce(c.n, 0) AS count
FROM (SELECT * FROM range(0, 50) t(b)) g
LEFT JOIN (SELECT CAST(least(49, floor((residual - rs.lo_r) / rs.w_r)) AS BIGINT) AS b, count(*) AS n
           FROM rp, rs GROUP BY 1) c ON c.b = g.b
UNION ALL
SELECT 'cloud' AS kind, CAST(least(49, floor((pred - rs.lo_p) / rs.w_p)) AS BIGINT) AS bin_x,
       CAST(least(49, floor((residual - rs.lo_r) / rs.w_r)) AS BIGINT) AS bin_y, count(*) AS count
FROM rp, rs GROUP BY 2, 3""", None, RESIDUAL_CTES)
def residual_profile(spark, sf):
    from staylens.plans.q_models import ols_scored
    return X.residual_profile(ols_scored(spark, sf), "label", "prediction", 50)


# Two standardised features: the components are their sum and difference; the first is the
# difference if they are negatively correlated (largest loading positive).
PROJECTION_SQL = """
SELECT id, CASE WHEN r >= 0 THEN (z1 + z2) / sqrt(2.0) ELSE (z1 - z2) / sqrt(2.0) END AS pc1,
       CASE WHEN r >= 0 THEN (z1 - z2) / sqrt(2.0) ELSE (z1 + z2) / sqrt(2.0) END AS pc2, seg
FROM (SELECT id, seg, (f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER () AS z1, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS z2
      FROM cluster_points), (SELECT corr(f1, f2) AS r FROM cluster_points)"""


@register("cluster_projection", PROJECTION_SQL, {"pc1": 6, "pc2": 6})
def cluster_projection(spark, sf):
    pts = frames.cluster_points(spark, sf)
    return X.cluster_projection(pts, frames.CLUSTER_COLS, "seg", "id")
