"""Parameters that the queries and their oracles share."""

#: Chunk sizes that suit documents of a few KiB; the defaults of the chunker suit files.
CHUNKS = (64, 256, 1024)
#: Ids per joined item.
SHELF = 1000
