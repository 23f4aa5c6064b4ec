"""Measure how evenly the work of each shuffle stage is spread when one
visitor holds a third of all events.

    python tools/skew_check.py [sf_dir] [scratch_dir]

A hot-visitor copy of the events (every third event reassigned to one user)
is written to ``scratch_dir``; the session export, the visitor history, the
enriched session table and the purchaser share then run with Spark's event
log on and adaptive partition coalescing off (so partitions stay as the
shuffle made them).  For every stage that reads shuffle data the tool prints
the largest share of the stage's shuffle records read by one task.  A hot
key kept in one task would show a share of at least a third.
"""

import glob
import json
import os
import sys
import tempfile
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from weblytics.operators import features, history, reports  # noqa: E402
from weblytics.session import configure  # noqa: E402
from weblytics.sources import fixture  # noqa: E402

HOT_USER = 7


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="skew-")
    logs = os.path.join(scratch, "eventlog")
    os.makedirs(logs, exist_ok=True)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", logs)
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.shuffle.partitions", "32")
             .config("spark.checkpoint.dir", os.path.join(scratch, "work"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # keep the shuffle joins

    base = os.path.join(scratch, f"hot-{uuid.uuid4().hex}")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    (ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(HOT_USER).cast("long"))
                   .otherwise(F.col("user_id")))
       .write.parquet(f"{base}/events.parquet"))
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")

    jobs = {}

    def run(label, fn):
        spark.sparkContext.setJobGroup(label, label)
        fn()
        jobs[label] = True

    store = None

    def export():
        nonlocal store
        store = fixture.export_sessions(spark, base, f"{base}/export")

    run("export", export)
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    run("visitor_history", lambda: noop(history.prior_days(store.all())))
    run("enriched_sessions", lambda: noop(features.main_dataset(store.all())))
    run("purchaser_share", lambda: noop(reports.purchaser_share(store.all())))
    app = spark.sparkContext.applicationId
    spark.stop()

    # --- read the event log -------------------------------------------------
    path = sorted(glob.glob(os.path.join(logs, f"*{app}*")))[0]
    if os.path.isdir(path):
        files = sorted(glob.glob(os.path.join(path, "events_*")))
    else:
        files = [path]
    stage_group, per_stage = {}, {}
    job_group = {}
    for f in files:
        for line in open(f):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
                job_group[e["Job ID"]] = group
            elif kind == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage.setdefault(e["Stage ID"], []).append(recs)
    print("| job | stage | tasks | shuffle records | largest task share |")
    print("| --- | --- | --- | --- | --- |")
    worst = 0.0
    for sid, recs in sorted(per_stage.items()):
        total = sum(recs)
        if total < 1000:   # tiny stages (dimension tables, final merges) are not telling
            continue
        share = max(recs) / total
        worst = max(worst, share)
        print(f"| {stage_group.get(sid)} | {sid} | {len(recs)} | {total} | {share:.3f} |")
    print(f"\nlargest share of any stage: {worst:.3f} (hot visitor holds 1/3 of the events)")


if __name__ == "__main__":
    main()
