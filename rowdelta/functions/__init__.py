"""Column builders."""

from .compare import differs, float_equal, text_key, typed_key

__all__ = ["differs", "float_equal", "text_key", "typed_key"]
