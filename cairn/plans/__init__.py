"""Tables, collections, transactions and the query builder."""
