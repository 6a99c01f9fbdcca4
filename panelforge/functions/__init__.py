"""Column-expression helpers shared by every operator.

They encode the null rules of the panel model once: division by zero gives
NULL, NaN is NULL, a rolling statistic needs a full frame, a missing
comparison counts as false.
"""

from panelforge.functions.nulls import (  # noqa: F401
    div, is_true, flag, nan_to_null, clean_doubles, rnd,
)
from panelforge.functions.frames import PanelWindow, rolling  # noqa: F401
