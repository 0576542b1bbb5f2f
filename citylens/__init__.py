"""citylens — Spark-native analysis of city records (taxi trips, parking tickets).

Operators are plain ``DataFrame -> DataFrame`` (``citylens.operators``) or
``Column -> Column`` (``citylens.functions``) functions built only from
Spark's DataFrame/SQL functions.
"""

from citylens.functions import *  # noqa: F401,F403
from citylens.operators import *  # noqa: F401,F403
from citylens.session import ensure_checkpoint_dir, get_session, scratch_path  # noqa: F401
from citylens.sources import *  # noqa: F401,F403

__version__ = "0.1.0"
