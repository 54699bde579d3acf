"""Column -> Column building blocks. All are built-in Spark expressions (no UDFs)."""

from plaudit.functions.cleaning import *  # noqa: F401,F403
from plaudit.functions.text import *  # noqa: F401,F403
from plaudit.functions.scoring import *  # noqa: F401,F403
from plaudit.functions.versions import *  # noqa: F401,F403
