"""Periods of the registered queries on the test tables (which cover
20240101-20240130), each standing in for the corresponding period of the
original workload.  All are shard-suffix bounds, inclusive."""

PERIODS = {
    # one daily shard (original: 20170801)
    "shard": ("20240115", "20240115"),
    # one-month reports and the hit flattening: the whole calendar month
    "month": ("20240101", "20240131"),
    # two-month reports (original: 20161001-20161130)
    "two_month": ("20240101", "20240130"),
    # sessions with a known visitor (original: 20160801-20170801)
    "known_visitor": ("20240101", "20240130"),
    # model training period (original: 20160801-20170531)
    "train": ("20240101", "20240121"),
    # out-of-time hold-out period (original: 20170601-20170801)
    "test": ("20240122", "20240130"),
}
