"""Cartulary: catalog-matching analytics and corpus preparation on Spark DataFrames.

The package is organised by what a transformation is for:

* ``functions``  column expressions (digests, names, text)
* ``operators``  DataFrame -> DataFrame transformations
* ``sources``    readers for catalogs, assets and archives
* ``plans``      chains of operators, report and document sinks
* ``streaming``  the same transformations over landing directories
* ``queries``    ready queries with the SQL that states them
"""

__version__ = "0.1.0"
