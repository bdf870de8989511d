"""Errors raised on the driver while a plan is being built."""


class GridError(ValueError):
    """An argument or a table does not fit the operator."""


class NotFoundError(GridError):
    """A dataset, band or record does not exist."""


class NoDataError(GridError):
    """Nothing is left after selection, or no target period is complete."""


class UnsafeStoreError(RuntimeError):
    """A store holds data that no stored period accounts for."""


class ShapeError(RuntimeError):
    """A period does not have the cells the store expects."""


class SplitPeriodError(GridError):
    """A period that is stored already comes again from another file."""
