"""Pages -> sectioned, embedded text -> replaceable table and its indexes.

spark-submit jobs/case_sections.py --pages s3a://lake/pages --index-path s3a://lake/index/case_sections
"""

import argparse

from docketry.plans import case_sections as cases
from docketry.session import build_session


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--pages", required=True, help="parquet with file_path, page, page_text, blocks (array of label and text)")
    options.add_argument("--namespace", default=cases.NAMESPACE)
    options.add_argument("--table", default=cases.TABLE)
    options.add_argument("--index-path", help="where to write the indexes; none without it")
    options.add_argument("--documents", type=int, help="the first so many of each file; all without it")
    options.add_argument("--keep-last-section", action="store_true")
    args = options.parse_args()

    spark = build_session("case-sections")
    name = cases.store_case_sections(
        spark.read.parquet(args.pages),
        args.namespace,
        args.table,
        n=args.documents,
        keep_last_section=args.keep_last_section,
    )
    if args.index_path:
        cases.index_case_sections(spark.table(name), args.index_path)
    spark.table(name).select("doc_id", "index_x", "section", "text").show(5, truncate=80)
    spark.stop()


if __name__ == "__main__":
    main()
