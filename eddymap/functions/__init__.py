from eddymap.functions.flow_math import (
    codelength_value, exit_flow, log2, merge_delta, module_term, number, plogp, plogp_value,
)

__all__ = [
    "codelength_value", "exit_flow", "log2", "merge_delta", "module_term", "number", "plogp",
    "plogp_value",
]
