"""Session settings: what configure() forces and what it leaves alone."""

import os
import subprocess
import sys

from weblytics.session import SQL_SETTINGS, configure, work_dir


def test_configure_forces_result_settings_and_keeps_tuning(spark):
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    old_coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        configure(spark)
        for key, value in SQL_SETTINGS.items():
            assert spark.conf.get(key) == value
        # a tuning choice of the caller survives
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old_coalesce)
        configure(spark)


def test_work_dir_is_the_sessions_checkpoint_dir(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir", work_dir(spark)).rstrip("/")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_local_start_without_any_setting(tmp_path):
    """A machine that presets nothing: a private folder, the same all along."""
    code = ("from weblytics.session import get_spark, work_dir\n"
            "spark = get_spark('local[1]', 1)\n"
            "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
            "path = work_dir(spark)\n"
            "assert work_dir(spark) == path and spark.sparkContext.getCheckpointDir()\n"
            "from weblytics.session import materialise\n"
            "assert materialise(spark.range(5), 'x').count() == 5\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
