from pyspark import cloudpickle

from . import csr_kernels, kernels, packed

# Ship the kernels inside the task closure, so executors need no copy of this package.
for _module in (kernels, csr_kernels, packed):
    cloudpickle.register_pickle_by_value(_module)
