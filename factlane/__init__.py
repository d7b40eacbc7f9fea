"""factlane: claim extraction and classifier evaluation as Spark DataFrame operators.

Sub-packages:

* ``sources``   - JSONL posts with a bad-line report, CSV in and out, the driver tables.
* ``functions`` - Column builders (text rules, seeded hashing, distribution tails).
* ``operators`` - DataFrame -> DataFrame operators: claim rules, cleaning, prompts,
  batch scoring, answer parsing, exact stratified splits, baselines, metrics,
  run statistics, reports.
* ``plans``     - the end-to-end jobs (extraction chain, split evaluation, full
  evaluation, encoder evaluation) and the registry of named queries.
* ``streaming`` - the extraction chain over a directory stream.
"""

__version__ = "0.1.0"
