"""Sequential trial emulation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from emulant.functions.design import Design, Level, Power, Term
from emulant.spec import PanelSpec

# Functions sent to executors carry this package with them, so a cluster needs no
# installation of it beside the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Design", "Level", "PanelSpec", "Power", "Term"]
