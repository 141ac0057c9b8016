"""stratafac: robust matrix factorisation on Spark DataFrames.

Rating tables are plain ``DataFrame<user: bigint, item: bigint, rating: double>``.
Everything downstream (statistics, shilling attacks, factor initialisation,
gradients, block-stratified SGD, Langevin sampling, evaluation) is expressed
as DataFrame plans; Python runs only inside Arrow-batched grouped-map tasks
where a block of sequential SGD updates has to happen in order.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Grouped-map functions (the DSGD block worker) are shipped to executors by
# value, so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from stratafac.session import ensure_checkpoint_dir, get_spark  # noqa: E402

__all__ = ["get_spark", "ensure_checkpoint_dir"]
