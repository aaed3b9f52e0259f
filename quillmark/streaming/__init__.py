"""Nothing here streams: the analysis has no unbounded source, watermark or keyed state.

The nearest thing is the resumable cache of parsed documents, which is a table keyed by a
content hash (``operators.audit.reuse_cached``, ``sources.sinks.put_cache``).
"""
