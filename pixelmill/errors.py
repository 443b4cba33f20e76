"""Errors by what went wrong; the names and codes follow the public error table of the operator set."""


class RasterError(ValueError):
    code = -1


class RangeError(RasterError):
    code = -2


class BoundsError(RasterError):
    code = -3


class TooLargeError(RasterError):
    code = -5


class UnknownFormatError(RasterError):
    code = -6


class UnsupportedCodecError(RasterError):
    code = -7


class CorruptError(RasterError):
    code = -8


class UnsupportedVariantError(RasterError):
    code = -9


class NotFoundError(RasterError):
    code = -13


class PlanError(RasterError):
    code = -14


class BudgetError(RasterError):
    code = -15


CODES = {c.code: c for c in RasterError.__subclasses__()}


def error_name(code: int) -> str:
    return "OK" if code == 0 else CODES[code].__name__ if code in CODES else "UNKNOWN"
