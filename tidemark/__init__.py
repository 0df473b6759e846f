"""tidemark: point-in-time news and market analytics expressed as Spark DataFrame programs.

Layout
    functions/   column expressions (no shuffles)
    sources/     readers, validation, source plug-ins, views over the benchmark tables
    operators/   DataFrame -> DataFrame operators
    plans/       end-to-end compositions and the registered queries
    streaming/   Structured Streaming jobs built from the same operators
"""

__version__ = "0.1.0"
