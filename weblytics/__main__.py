"""Command line.

    python -m weblytics list
    python -m weblytics run NAME --sf-dir DIR [--show N | --out PATH]
    python -m weblytics report NAME --sessions ROOT [--layout split|nested]
                              --start YYYYMMDD --end YYYYMMDD [--show N | --out PATH]
    python -m weblytics explore preview|known_visitors|hits --sessions ROOT
                              [--layout ..] --start YYYYMMDD --end YYYYMMDD [--show N | --out PATH]
    python -m weblytics train MODEL --sessions ROOT --start .. --end .. --model PATH
    python -m weblytics evaluate MODEL --sessions ROOT --start .. --end .. --model PATH
                              [--confusion] [--show N | --out PATH]
    python -m weblytics publish --sessions ROOT --start .. --end .. --model PATH
                              --table PATH [--run-date YYYY-MM-DD] [--append]

``run`` executes a registered query on a test-data folder; ``report`` runs a
report, metric table or feature set on any stored session table (for
example an analytics export in the nested layout) over any shard range.
``train`` fits model MODEL (basic, extended, enriched, history) on its
feature set of the period and stores it (replacing); ``evaluate`` scores the
period with a stored model; ``publish`` scores the period with a stored
history model and writes the date-partitioned predictions table.
``--out`` writes Parquet (the result stays distributed); ``--show`` prints
the first N rows.
"""

from __future__ import annotations

import argparse
import sys

from .operators import features, metrics, reports
from .session import get_spark
from .sources import SessionStore

PERIOD_JOBS = {
    "tx_by_device_browser": reports.tx_by_device_browser,
    "bounce_by_source": reports.bounce_by_source,
    "conversion_by_os_device_browser": reports.conversion_by_os_device_browser,
    "purchaser_share": reports.purchaser_share,
    "revenue_by_source_medium": reports.revenue_by_source_medium,
    "top_bounce_countries": reports.top_bounce_countries,
    "time_by_device": reports.time_by_device,
    "campaigns": reports.campaigns,
    "pageviews_by_browser": reports.pageviews_by_browser,
    "sessions_by_weekday": reports.sessions_by_weekday,
    "traffic_metrics": metrics.traffic,
    "device_metrics": metrics.device,
    "temporal_metrics": metrics.temporal,
    "user_metrics": metrics.users,
    "conversion_metrics": metrics.conversion,
    "features_basic": features.basic,
    "features_extended": features.extended,
    "features_enriched": features.enriched,
}


def _emit(df, args) -> None:
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m weblytics")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries and period jobs")
    r = sub.add_parser("run", help="a registered query on a test-data folder")
    r.add_argument("name")
    r.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    q = sub.add_parser("report", help="a period job on a stored session table")
    q.add_argument("name", choices=sorted(PERIOD_JOBS) + ["features_history"])
    q.add_argument("--sessions", required=True, help="root folder of the session table")
    q.add_argument("--layout", choices=["split", "nested"], default="nested")
    q.add_argument("--start", required=True)
    q.add_argument("--end", required=True)
    x = sub.add_parser("explore", help="preview a shard, known visitors, one row per hit")
    x.add_argument("name", choices=["preview", "known_visitors", "hits"])
    t = sub.add_parser("train", help="fit and store a model")
    e = sub.add_parser("evaluate", help="metrics of a stored model on a period")
    e.add_argument("--confusion", action="store_true", help="confusion matrix instead")
    b = sub.add_parser("publish", help="score a period and write the predictions table")
    b.add_argument("--table", required=True)
    b.add_argument("--run-date", default=None, help="YYYY-MM-DD; default today")
    b.add_argument("--append", action="store_true", help="insert instead of replacing the date")
    for sp in (t, e):
        sp.add_argument("name", choices=["basic", "extended", "enriched", "history"])
    for sp in (x, t, e, b):
        sp.add_argument("--sessions", required=True)
        sp.add_argument("--layout", choices=["split", "nested"], default="nested")
        sp.add_argument("--start", required=True)
        sp.add_argument("--end", required=True)
    for sp in (t, e, b):
        sp.add_argument("--model", required=True, help="folder of the stored model")
    for sp in (r, q, x, t, e, b):
        sp.add_argument("--show", type=int, default=20)
        sp.add_argument("--out", default=None)
        sp.add_argument("--master", default=None, help="e.g. local[8]; default: spark-submit's")
    args = p.parse_args(argv)

    if args.cmd == "list":
        from .plans.catalogue import queries
        print("registered queries:", *queries(), sep="\n  ")
        print("period jobs:", *sorted(PERIOD_JOBS), "features_history", sep="\n  ")
        return 0
    spark = get_spark(args.master)
    if args.cmd == "run":
        from .plans.catalogue import queries
        _emit(queries()[args.name](spark, args.sf_dir), args)
        return 0
    store = SessionStore(spark, args.sessions, layout=args.layout)
    store.require(args.start, args.end)
    if args.cmd in ("train", "evaluate", "publish"):
        return _model_command(spark, store, args)
    if args.cmd == "explore":
        from .operators import explore
        if args.name == "preview":   # the shard of --start
            rows = explore.preview(store.shard(args.start))
            df = store.with_hits(rows, args.start, args.start, max_sessions=100)
        elif args.name == "known_visitors":
            rows = explore.known_visitors(store.between(args.start, args.end))
            df = store.with_hits(rows, args.start, args.end)
        else:
            df = explore.unnest_hits(store, args.start, args.end)
        _emit(df, args)
        return 0
    period = store.between(args.start, args.end)
    if args.name == "features_history":
        df = features.history(period, store.all(), start=args.start, end=args.end)
    else:
        df = PERIOD_JOBS[args.name](period)
    _emit(df, args)
    return 0


def _model_command(spark, store, args) -> int:
    from .operators import evaluation
    from .plans import ml, publish
    if args.cmd == "train":
        data = features.for_model(store, args.name, args.start, args.end)
        trained = ml.train(spark, data, ml.MODELS[args.name])
        ml.save(trained.model, args.model, replace=True)
        _emit(trained.summary, args)
        return 0
    model = ml.load(args.model)
    if args.cmd == "evaluate":
        scored = ml.score(model, features.for_model(store, args.name, args.start, args.end))
        _emit(evaluation.confusion(scored) if args.confusion else evaluation.evaluate(scored), args)
        return 0
    scoring = features.for_model(store, "history", args.start, args.end, for_scoring=True)
    publish.publish(publish.predictions(model, scoring), args.table, args.run_date,
                    mode="append" if args.append else "replace_dates")
    return 0


if __name__ == "__main__":
    sys.exit(main())
