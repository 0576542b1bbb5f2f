"""Sources and sinks: typed CSV ingest, mixed folders, quarantine, month union, Parquet materialisation, audit ledger, test views."""

from citylens.sources.csv import count_malformed, read_ticket_years, read_tickets, read_trips, write_csv
from citylens.sources.quarantine import Split, split_rejects
from citylens.sources.tables import materialize, materialize_audited, union_months, with_year_month

__all__ = [
    "count_malformed", "read_ticket_years", "read_tickets", "read_trips", "write_csv", "Split", "split_rejects",
    "materialize", "materialize_audited", "union_months", "with_year_month",
]
