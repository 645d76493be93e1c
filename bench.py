"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pairloom.plans.catalog import CATALOG  # noqa: E402
from pairloom.session import build_session  # noqa: E402

HEADLINE = (
    "ing14_sentence_rows",
    "ing15_legacy_rows",
    "cln05_clean_transcript",
    "cln07_word_set",
    "pro01_f0_summary",
    "pro06_word_markers",
    "pro08_apply_marks",
    "flt04_norm_levenshtein",
    "flt06_label_collisions",
    "flt07_class_caps",
    "flt09_gate_report",
    "dst05_sft_text",
    "dst09_prompt_table",
    "dst10_classifier_table",
    "rwd02_copy_margin",
    "rwd04_edit",
    "rwd14_group_normalized",
    "met01_bleu",
    "met02_chrf",
    "met11_all_metrics",
    "met14_bucket_metrics",
    "met17_token_accuracy",
    "ldb06_pareto_frontier",
    "ldb11_multi_region",
    "sig04_significance_block",
    "sig02_poisson_bootstrap",
    "cls01_class_report",
    "cls07_ceiling_summary",
    "ops02_latency_summary",
    "ops06_step_throughput",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="pairloom-bench",
        master=f"local[{cpus}]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    CATALOG["flt01_drop_identical"].run(spark, sf_dir).count()  # starts the engine
    CATALOG["rwd01_content"].run(spark, sf_dir).limit(1).collect()  # starts the Python workers
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
