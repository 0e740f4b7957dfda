"""ledgerlens: subscription and payment analytics as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function. Nothing in the
library collects to the driver or uses Python UDFs; planning is left to
Catalyst and adaptive query execution.
"""

from ledgerlens.session import build_session  # noqa: F401

DEFAULT_AS_OF = "2022-06-20 12:00:00"
