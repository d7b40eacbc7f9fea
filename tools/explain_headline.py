"""Print the formatted physical plans of the headline queries.

usage: python tools/explain_headline.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["q1_claim_domains", "p6_claim_funnel", "g8_metrics_record", "r10_reasoning", "a5_one_sample_ttest",
           "t2_stratified_split", "w2_error_examples"]


def main():
    from factlane.plans.catalog import QUERIES
    from factlane.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = local_session(8, 8)
    for name in args or DEFAULT:
        print(f"==================== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
