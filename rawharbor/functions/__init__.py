from rawharbor.functions import matching, nulls, text

__all__ = ["matching", "nulls", "text"]
