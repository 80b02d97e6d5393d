"""basepack: chunked, bit-packed nucleotide arrays on PySpark."""
