"""Arrival events -> document messages -> markdown, up to what has arrived.

Run it on a schedule; a run goes on where the last one stopped and delivers failed events again, up to the limit. `--root` is a folder
with `arrivals/` (envelopes) and `pages/` (one folder per source file).

spark-submit jobs/document_stream.py --root s3a://lake/stream --max-files 100
"""

import argparse

from docketry.functions.paths import INPUT_PREFIX
from docketry.operators.messages import MAX_DELIVERY_ATTEMPTS
from docketry.session import build_session
from docketry.sinks.catalog import replace_table
from docketry.streaming.arrivals import Layout, outstanding, redeliver, start_index_stream
from docketry.streaming.convert import start_convert_stream


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--root", required=True)
    options.add_argument("--prefix", default=INPUT_PREFIX)
    options.add_argument("--max-files", type=int, default=100, help="input files per micro-batch")
    options.add_argument("--max-attempts", type=int, default=MAX_DELIVERY_ATTEMPTS)
    options.add_argument("--namespace", default="sandbox", help="namespace of the dead_letters table")
    args = options.parse_args()

    spark = build_session("document-stream")
    layout = Layout(args.root.rstrip("/"))
    redeliver(spark, layout, args.max_attempts)
    start_index_stream(spark, layout, args.max_files, args.prefix).awaitTermination()
    start_convert_stream(spark, layout, args.max_files).awaitTermination()
    _, dead = outstanding(spark, layout, args.max_attempts)
    replace_table(dead, args.namespace, "dead_letters")
    spark.stop()


if __name__ == "__main__":
    main()
