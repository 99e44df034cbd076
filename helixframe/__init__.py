"""helixframe: a PySpark engine for regulatory-network and omics tables."""

__version__ = "0.1.0"
