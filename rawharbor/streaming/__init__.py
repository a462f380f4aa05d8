from rawharbor.streaming import landed, rate

__all__ = ["landed", "rate"]
