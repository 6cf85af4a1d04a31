"""strandline.functions"""
