from barloom.catalog.base import ORACLES, QUERIES  # noqa: F401
from barloom.catalog import indicators  # noqa: F401
from barloom.catalog import rules  # noqa: F401
from barloom.catalog import market  # noqa: F401
from barloom.catalog import scores  # noqa: F401
from barloom.catalog import outcomes  # noqa: F401
from barloom.catalog import factors  # noqa: F401
from barloom.catalog import archive  # noqa: F401
from barloom.catalog import monitor  # noqa: F401
from barloom.catalog import reference  # noqa: F401
from barloom.catalog import streaming  # noqa: F401
from barloom.catalog import learning  # noqa: F401
from barloom.catalog import evaluation  # noqa: F401
