"""Structured Streaming: the same operators over monthly files as they arrive.

The case studies load one file per month (and one per year) and re-run
their audits over the combined table.  Here the audits are kept
incrementally instead: a file-source stream feeds a stateful aggregation
whose state lives in the checkpoint folder, so each new month costs only
its own rows and a restarted or re-scheduled job resumes where it stopped.
"""

from citylens.streaming.incremental import (
    incremental_count_by,
    incremental_rule_counts,
    read_csv_stream,
    run_available,
)

__all__ = ["incremental_count_by", "incremental_rule_counts", "read_csv_stream", "run_available"]
