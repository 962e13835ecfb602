"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from slotcast.session import local_session
from slotcast.workload import QUERIES

HEADLINE = (
    "hour_of_week_profile", "read_parquet", "normalise_sales", "time_parts", "primetime",
    "fill_exposed", "carry_day", "parttime", "show_id", "assign_show", "show_sequence",
    "add_categories", "add_click_rates", "add_age_shares", "member_flag", "triplet_tournament",
    "sales_power", "dup_times", "prev_week_price_product_code", "prev_week_shows_mother_code",
    "prev_day_price", "prev_show_price", "lag_sales_divided", "rolling_means",
    "rolling_means_large", "prev_week_price_large", "mean_sales_origin", "history_shifted_lags",
    "category_mix", "top_per_hour", "freq_items", "brand_power", "quantiles", "seasonal_top",
    "mix_predictions", "label_encode", "label_encode_stacked", "one_hot", "remove_outliers",
    "corr_matrix", "autocorrelation", "histogram", "cross_schedule", "grid_category_profit",
    "week_candidates", "assign_flat", "assign_products", "extract_links", "train_features",
    "two_tier_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, partitions=max(8, cpus), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["time_parts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
