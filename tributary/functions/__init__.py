"""Column functions for dirty values. Bad data gives NULL, never an error."""

from tributary.functions.binding import Expr, as_expr, transformation
from tributary.functions.arrays import str_to_array
from tributary.functions.boolean import has_value, to_bool
from tributary.functions.jsonfmt import to_json_string
from tributary.functions.lookup import map_values
from tributary.functions.numeric import meters_to_cm, to_double, to_float, to_int, to_long, to_num
from tributary.functions.temporal import to_timestamp
from tributary.functions.text import apply, as_is, to_str

#: Names by which specifications refer to functions.
REGISTRY = {f.__name__: f for f in (
    apply, as_is, has_value, map_values, meters_to_cm, str_to_array, to_bool, to_double, to_float, to_int, to_json_string,
    to_long, to_num, to_str, to_timestamp,
)}

__all__ = [*REGISTRY, "Expr", "as_expr", "transformation", "REGISTRY"]
