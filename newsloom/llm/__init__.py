"""Training-data operators: archives, scans, classifiers, joins, packing.

Nothing outside this subpackage imports it; ``queries`` lists what it offers.
"""
