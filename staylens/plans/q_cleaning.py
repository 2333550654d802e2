"""Registered queries: projections, predicates and scalar cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import cleaning as C
from staylens.plans import frames
from staylens.plans.registry import register

LOG10 = {"log_price": 10}


@register("drop_columns", "SELECT * EXCLUDE (id, name, host_id, host_name, bathrooms_text) FROM listings_raw")
def drop_columns(spark, sf):
    return C.drop_columns(frames.raw(spark, sf))


@register("percent_to_fraction", """
SELECT id, CAST(rtrim(host_response_rate, '%') AS DOUBLE) / 100.0 AS host_response_rate,
       CAST(rtrim(host_acceptance_rate, '%') AS DOUBLE) / 100.0 AS host_acceptance_rate
FROM listings_raw""")
def percent_to_fraction(spark, sf):
    return C.percent_to_fraction(frames.raw(spark, sf)).select("id", "host_response_rate", "host_acceptance_rate")


@register("flag_to_int", """
SELECT id, CASE host_is_superhost WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS host_is_superhost FROM listings_raw""")
def flag_to_int(spark, sf):
    return C.flag_to_int(frames.raw(spark, sf)).select("id", "host_is_superhost")


@register("extract_number", r"""
SELECT id, CAST(nullif(regexp_extract(bathrooms_text, '(\d+(\.\d+)?)', 1), '') AS DOUBLE) AS bathrooms
FROM listings_raw""")
def extract_number(spark, sf):
    return C.extract_number(frames.raw(spark, sf)).select("id", "bathrooms")


@register("parse_money", """
SELECT id, CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price FROM listings_raw""")
def parse_money(spark, sf):
    return C.parse_money(frames.raw(spark, sf)).select("id", "price")


@register("positive_filter", "SELECT id, price FROM listings_positive")
def positive_filter(spark, sf):
    return C.positive_filter(C.parse_money(frames.raw(spark, sf))).select("id", "price")


@register("quantile_cap", """
SELECT k.id, k.price, c.cap FROM listings_capped k, listings_cap c""", {"cap": 6})
def quantile_cap(spark, sf):
    parsed = C.parse_money(frames.raw(spark, sf))
    model = C.PriceCap("price", 0.99).fit(parsed)
    return model.transform(parsed).select("id", "price", F.lit(model.cap_value).alias("cap"))


@register("drop_duplicates", "SELECT DISTINCT * EXCLUDE (id) FROM listings_capped")
def drop_duplicates(spark, sf):
    r = frames.raw(spark, sf)
    m = C.ListingCleaner(logTarget=False).fit(r)
    capped = C.PriceCapModel("price", 0.99, m.cap_value).transform(m.parsed(r))
    return C.drop_duplicates(capped)


@register("dropna_key_columns", """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE kept) AS rows_after,
       CAST(sum(cells) AS BIGINT) AS null_cells_before,
       CAST(sum(CASE WHEN kept THEN cells ELSE 0 END) AS BIGINT) AS null_cells_after
FROM (SELECT CAST(price IS NULL AS INTEGER) + CAST(room_type IS NULL AS INTEGER)
             + CAST(neighbourhood IS NULL AS INTEGER) AS cells,
             price IS NOT NULL AND room_type IS NOT NULL AND neighbourhood IS NOT NULL AS kept
      FROM (SELECT DISTINCT * EXCLUDE (id) FROM listings_capped))""")
def dropna_key_columns(spark, sf):
    r = frames.raw(spark, sf)
    m = C.ListingCleaner(logTarget=False).fit(r)
    deduped = C.drop_duplicates(C.PriceCapModel("price", 0.99, m.cap_value).transform(m.parsed(r)))
    return C.dropna_report(deduped, C.KEY_COLS)


@register("log_target", "SELECT price, log_price FROM listings_clean", LOG10)
def log_target(spark, sf):
    return frames.clean(spark, sf).select("price", "log_price")


SELECT_CANDIDATES = ["accommodates", "bedrooms", "bathrooms", "review_scores_rating", "minimum_nights",
                     "host_is_superhost", "neighbourhood", "room_type", "latitude"]


@register("select_existing", """
SELECT accommodates, bedrooms, bathrooms, review_scores_rating, minimum_nights, host_is_superhost,
       neighbourhood, room_type, log_price FROM listings_clean""", LOG10)
def select_existing(spark, sf):
    return C.select_existing(frames.clean(spark, sf), SELECT_CANDIDATES, "log_price")


@register("flag_default_false", """
SELECT id, CASE WHEN host_is_superhost IN ('t', 'true') THEN 1 ELSE 0 END AS host_is_superhost FROM listings_raw""")
def flag_default_false(spark, sf):
    return C.flag_default_false(frames.raw(spark, sf)).select("id", "host_is_superhost")


@register("numeric_columns", """
SELECT host_listings_count, calculated_host_listings_count, accommodates, bedrooms, beds, minimum_nights,
       number_of_reviews, review_scores_rating, host_response_rate, host_acceptance_rate, host_is_superhost,
       price, bathrooms, log_price FROM listings_clean""", LOG10)
def numeric_columns(spark, sf):
    return C.select_numeric(frames.clean(spark, sf))


@register("fill_zero", """
SELECT id, coalesce(bedrooms, 0) AS bedrooms, coalesce(beds, 0) AS beds,
       coalesce(review_scores_rating, 0.0) AS review_scores_rating, coalesce(bathrooms, 0.0) AS bathrooms
FROM listings_keyed_clean""")
def fill_zero(spark, sf):
    return C.fill_zero(frames.keyed(spark, sf), ["bedrooms", "beds", "review_scores_rating", "bathrooms"]) \
        .select("id", "bedrooms", "beds", "review_scores_rating", "bathrooms")


ROOM_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummy_sql(col, levels):
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{col}_{v}\"" for v in levels)


@register("ensure_column", f"""
SELECT id, minimum_nights, calculated_host_listings_count, {_dummy_sql('room_type', ROOM_LEVELS[1:])},
       0 AS "room_type_Private room", 0 AS "room_type_Shared room"
FROM listings_keyed_clean""")
def ensure_column(spark, sf):
    from staylens.operators.features import OneHotColumns
    k = frames.keyed(spark, sf).select("id", "minimum_nights", "calculated_host_listings_count", "room_type")
    enc = OneHotColumns(["room_type"], dropFirst=True).fit(k).transform(k)
    return C.ensure_column(enc, ["room_type_Private room", "room_type_Shared room"])


@register("segment_filter", "SELECT id, f1, seg FROM cluster_points WHERE seg = 1")
def segment_filter(spark, sf):
    return C.segment_filter(frames.cluster_points(spark, sf), 1, "seg").select("id", "f1", "seg")


@register("min_segment_size", """
SELECT accommodates, count(*) AS rows, count(*) >= 20 AS keep FROM listings_clean GROUP BY accommodates""")
def min_segment_size(spark, sf):
    return C.min_segment_size(frames.clean(spark, sf), "accommodates", 20)


@register("rename_prediction", "SELECT id, prediction AS predicted_reviews FROM ols_scored", {"predicted_reviews": 6})
def rename_prediction(spark, sf):
    from staylens.plans.q_models import ols_scored
    return C.rename_prediction(ols_scored(spark, sf), "predicted_reviews").select("id", "predicted_reviews")


@register("residuals", "SELECT id, label - prediction AS residual FROM ols_scored", {"residual": 6})
def residuals(spark, sf):
    from staylens.plans.q_models import ols_scored
    return C.residuals(ols_scored(spark, sf), "label").select("id", "residual")


@register("shape_audit", """
SELECT 'before' AS stage, count(*) AS rows, CAST(20 AS BIGINT) AS columns FROM listings_raw
UNION ALL
SELECT 'after' AS stage, count(*) AS rows, CAST(17 AS BIGINT) AS columns FROM listings_clean""")
def shape_audit(spark, sf):
    return C.shape_audit(frames.raw(spark, sf), frames.clean(spark, sf))
