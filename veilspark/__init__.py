"""Personal data in document tables: find, score, mask, pseudonymise, restore and evaluate, as Spark plans."""

__version__ = "0.1.0"
