"""Training-data pipeline operators (licenses, decontamination, packing, ...).

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame plus the names of the columns it reads, touches no other column, and
quotes all names, so extra columns with any name are harmless.
"""
