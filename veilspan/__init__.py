"""Sensitive-span detection, redaction and evaluation as Spark DataFrame operators."""

from importlib import import_module

__version__ = "0.1.0"
_PLACES = {
    "redact": "veilspan.operators.redact",
    "Redactor": "veilspan.operators.redact",
    "DecodeOptions": "veilspan.operators.decode",
    "Decoder": "veilspan.operators.decode",
    "INHERIT": "veilspan.operators.decode",
    "LabelSpace": "veilspan.functions.labels",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """The public names, whose modules are loaded when first asked for."""
    if name not in _PLACES:
        raise AttributeError(f"veilspan has no {name}")
    return getattr(import_module(_PLACES[name]), name)
