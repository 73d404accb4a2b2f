"""Reading, writing and upserting tables; views of the test tables."""
