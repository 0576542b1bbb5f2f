"""Parameters of the case-study analyses as run on the test views.

The real analyses use November-December 2017 for trips and the ticket
file's fiscal year; the test views span 1995-2001, so the same analyses
use November-December 1997 and 1997.
"""

PERIOD_YEAR = 1997
PERIOD_MONTHS = (11, 12)
HOLIDAY_MONTH = 12
HOLIDAY_DAYS = (25, 31)
BAD_RATE_CODE = 99
TIP_EDGES = (0, 5, 10, 15, 20)
TICKET_YEAR = 1997
CLOCK_YEAR = 2024
TOP_N = 5
TOP_K = 3
COMMON_PER_GROUP = 5
SPARSE_MAX_MISSING = 0.2
# Years compared side by side (the ticket files cover three fiscal years); the rest is one column.
COMPARE_YEARS = (1996, 1997, 1998)
