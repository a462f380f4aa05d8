from rawharbor.sources import delimited, html, members, payloads, registry

__all__ = ["delimited", "html", "members", "payloads", "registry"]
