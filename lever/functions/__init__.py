"""Column expressions, join helpers and small solvers used by the operators."""
from lever.functions.columns import fold_of_index, join_on, nan_to_null

__all__ = ["fold_of_index", "join_on", "nan_to_null"]
