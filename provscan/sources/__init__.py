"""provscan.sources"""
