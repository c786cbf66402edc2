"""Operators over the document library, each with a query on the driver's tables."""
