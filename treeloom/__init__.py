"""treeloom: XML trees as tables, XPath as DataFrame plans."""

__version__ = "0.1.0"
